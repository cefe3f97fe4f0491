"""Containers, rolling, imputation, selection, pipelines, sources and streams."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import chronofold as cf
from chronofold.functions import tests_of_significance as ts
from chronofold.operators import impute as imp
from chronofold.operators import relevance
from chronofold.sources import cli, readers
from chronofold.streaming.windows import windowed_features

MEAN = {"mean": None}


# --- containers


def test_forms_of_input_agree(spark):
    wide = spark.createDataFrame([(1, t, float(t), -float(t)) for t in range(5)] + [(2, 0, 3.0, 4.0)], "id long, t long, a double, b double")
    long = wide.select("id", "t", F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("kind", "v"))
    parts = {x: wide.select("id", "t", F.col(x).alias("v")) for x in "ab"}
    rows = [
        sorted(map(tuple, cf.extract_features(c, cf.MinimalFCParameters(), column_id="id", column_sort="t", **more).collect()))
        for c, more in ((wide, {}), (long, {"column_kind": "kind", "column_value": "v"}), (long, {"column_kind": "kind"}), (parts, {"column_value": "v"}))
    ]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) == 2


@pytest.mark.parametrize(
    "schema,data,options",
    [
        ("id long, a__b double", [(1, 1.0)], {}),
        ("id long, a_ double", [(1, 1.0)], {}),
        ("id long", [(1,)], {}),
        ("id long, a double", [(1, None)], {}),
        ("id long, a double", [(1, float("nan"))], {}),
        ("id long, a double", [(None, 1.0)], {}),
        ("id long, a double", [(1, 1.0)], {"column_sort": "t"}),
        ("id long, k string, a double, b double", [(1, "x", 1.0, 2.0)], {"column_kind": "k"}),
    ],
)
def test_bad_input_is_an_error(spark, schema, data, options):
    with pytest.raises(ValueError):
        cf.extract_features(spark.createDataFrame(data, schema), MEAN, column_id="id", **options)


# --- rolling

ROLL = [(1, t, float(t), float(t + 4)) for t in range(1, 5)] + [(2, 8, 10.0, 12.0), (2, 9, 11.0, 13.0)]


def _windows(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["id"]["id"], r["id"]["timeshift"]), []).append(r["x"])
    return {k: sorted(v) for k, v in out.items()}


def slices(direction, most, least):
    groups = {1: [(t, float(t)) for t in range(1, 5)], 2: [(8, 10.0), (9, 11.0)]}
    longest, out = 4, {}
    m = most or longest
    shifts = range(longest, 0, -direction) if direction > 0 else range(1, longest + 1, -direction)
    for t in shifts:
        for g, x in groups.items():
            if direction > 0:
                part = x[max(t - m - 1, 0) : t] if t <= len(x) else []
            else:
                part = x[t - 1 : t + m]
            if len(part) >= least + 1:
                out[g, part[-1 if direction > 0 else 0][0]] = [v for _, v in part]
    return out


@pytest.mark.parametrize("direction", [1, 2, 3, -1, -2])
@pytest.mark.parametrize("most,least", [(None, 0), (1, 0), (2, 1), (None, 2)])
def test_rolling_equals_slices(spark, direction, most, least):
    df = spark.createDataFrame(ROLL, "id long, time long, x double, y double")
    assert _windows(cf.roll_time_series(df, "id", "time", None, direction, most, least)) == slices(direction, most, least)


def test_rolling_errors_and_unsorted(spark):
    df = spark.createDataFrame(ROLL, "id long, time long, x double, y double").coalesce(1)
    for bad in ({"rolling_direction": 0}, {"max_timeshift": 0}, {"min_timeshift": -1}):
        with pytest.raises(ValueError):
            cf.roll_time_series(df, "id", "time", **bad)
    with pytest.raises(AttributeError):
        cf.roll_time_series(df, "nobody", "time")
    with pytest.raises(ValueError):
        cf.roll_time_series(df.limit(1), "id", "time")
    with pytest.raises(ValueError):
        cf.roll_time_series(df.withColumn("time", F.lit(None).cast("long")), "id", "time")
    got = cf.roll_time_series(df.drop("time"), "id")
    assert got.columns == ["id", "x", "y", "sort"] and sorted({(r["id"]["id"], r["id"]["timeshift"]) for r in got.collect()}) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_forecasting_and_pieces(spark):
    x = spark.createDataFrame([(t, float(t)) for t in range(5)], "time long, value double")
    frame, target = cf.make_forecasting_frame(x, "k", 2)
    assert sorted((r["id"]["timeshift"], r["y"]) for r in target.collect()) == [(t, float(t)) for t in range(1, 5)]
    assert sorted((r["id"]["timeshift"], r["time"]) for r in frame.collect()) == [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 2), (4, 3)]
    df = spark.createDataFrame(ROLL, "id long, time long, x double, y double")
    got = cf.add_sub_time_series_index(df, 3, "id", "time")
    assert sorted((r["id"]["chunk"], r["id"]["id"], r["time"]) for r in got.collect()) == [(0, 1, 1), (0, 1, 2), (0, 1, 3), (0, 2, 8), (0, 2, 9), (1, 1, 4)]


# --- imputation


def test_imputation(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, 1.0, nan), (2, inf, inf), (3, -inf, None), (4, 3.0, nan), (5, None, -inf)], "id long, a double, `b c` double")
    assert [tuple(r) for r in cf.impute(df).orderBy("id").collect()] == [(1, 1.0, 0.0), (2, 3.0, 0.0), (3, 1.0, 0.0), (4, 3.0, 0.0), (5, 2.0, 0.0)]
    assert {r["a"] for r in cf.impute_dataframe_zero(df).collect()} == {1.0, 0.0, 3.0}
    assert cf.impute(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cf.impute_dataframe_range(df, {"a": 1.0}, {"a": 1.0}, {"a": 1.0})
    with pytest.raises(ValueError):
        imp.check_for_nans_in_columns(df)
    with pytest.raises(ValueError):
        cf.PerColumnImputer(col_to_NAN_repl_preset={"z": 1.0}).fit(df)
    with pytest.raises(ValueError):
        cf.PerColumnImputer().transform(df)
    fitted = cf.PerColumnImputer(col_to_PINF_repl_preset={"a": 99.0}).fit(df)
    assert [r["a"] for r in fitted.transform(df).orderBy("id").collect()] == [1.0, 99.0, 1.0, 3.0, 2.0]


# --- tests and selection


def test_p_values():
    assert ts.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert ts.mann_whitney(0, 3, 3, 0) == pytest.approx(0.1)
    assert ts.mann_whitney(100 * 100 / 2, 100, 100, 0) == pytest.approx(1.0, abs=0.01)
    assert ts.kolmogorov_smirnov(1.0, 3, 3) == pytest.approx(0.1)
    assert ts.kolmogorov_smirnov(0.0, 5, 7) == 1.0
    assert ts.kolmogorov_smirnov(0.1, 20_000, 20_000) < 1e-10
    assert math.isnan(ts.kendall(0, 4, (6, 0, 0), (0, 0, 0), 0))


def test_lattice_paths_against_enumeration():
    from itertools import combinations

    m, n = 4, 5
    seen = []
    for first in combinations(range(m + n), m):
        a = b = 0
        top = 0.0
        for i in range(m + n):
            a, b = (a + 1, b) if i in first else (a, b + 1)
            top = max(top, abs(a / m - b / n))
        seen.append(top)
    for d in sorted(set(np.round(seen, 9))):
        assert ts.kolmogorov_smirnov(float(d), m, n) == pytest.approx(np.mean(np.array(seen) >= d - 1e-9))


def _features(spark, n=60):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, n)
    rows = [(i, float(y[i] + rng.normal(0, 0.3)), float(rng.normal()), float(y[i] == 1), 1.0, float(rng.integers(0, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, good double, noise double, flag double, flat double, coin double"), y


def test_concordance_counts_inversions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 50), rng.integers(0, 9, 50)
    f = spark.createDataFrame([(i, "v", float(a)) for i, a in enumerate(x)], "id long, variable string, value double")
    t = spark.createDataFrame([(i, float(b)) for i, b in enumerate(y)], "id long, y double")
    r = relevance.concordance(f, t).collect()[0]
    pairs = [(i, j) for i in range(50) for j in range(i)]
    assert r["discordant"] == sum((x[i] - x[j]) * (y[i] - y[j]) < 0 for i, j in pairs)
    assert (r["x0"], r["y0"], r["both"]) == (sum(x[i] == x[j] for i, j in pairs), sum(y[i] == y[j] for i, j in pairs), sum(x[i] == x[j] and y[i] == y[j] for i, j in pairs))


@pytest.mark.parametrize("test", ["mann", "smir"])
def test_selection_for_classes(spark, test):
    X, y = _features(spark)
    target = spark.createDataFrame([(i, f"c{v}") for i, v in enumerate(y)], "id long, y string")
    table = {r["feature"]: r for r in cf.calculate_relevance_table(X, target, test_for_binary_target_real_feature=test).collect()}
    assert {k: r["type"] for k, r in table.items()} == {"good": "real", "noise": "real", "flag": "binary", "flat": "constant", "coin": "binary"}
    assert {k for k, r in table.items() if r["relevant"]} == {"good", "flag"} and table["flat"]["p_value"] is None
    assert cf.select_features(X, target).columns == ["id", "good", "flag"]
    many = {r["feature"]: r for r in cf.calculate_relevance_table(X, target, multiclass=True, n_significant=2).collect()}
    assert many["good"]["relevant_c0"] and many["good"]["n_significant"] >= 2 and many["flat"]["n_significant"] == 0
    chosen = cf.FeatureSelector(multiclass=True, n_significant=2, multiclass_p_values="all").fit(X, target)
    assert chosen.transform(X).columns[0] == "id" and set(chosen.feature_importances_["good"]) == {"c0", "c1", "c2"}


def test_selection_for_numbers(spark):
    X, y = _features(spark)
    target = spark.createDataFrame([(i, float(v) + 0.01 * i) for i, v in enumerate(y)], "id long, y double")
    table = {r["feature"]: r for r in cf.calculate_relevance_table(X, target).collect()}
    assert table["good"]["relevant"] and not table["noise"]["relevant"]
    with pytest.raises(ValueError):
        cf.calculate_relevance_table(X, target, ml_task="guess")
    with pytest.raises(AssertionError):
        cf.select_features(X, target.withColumn("y", F.lit(1.0)))


@pytest.mark.parametrize("independent,ps,level,want", [(True, [0.1, 0.15, 0.2, 0.0], 0.2, [True] * 4), (False, [0.1, 0.15, 0.2, 0.0], 0.2, [False, False, False, True]), (True, [0.5, None], 0.1, [False, False])])
def test_false_discoveries(spark, independent, ps, level, want):
    df = spark.createDataFrame(list(enumerate(ps)), "i long, p_value double")
    assert [r["relevant"] for r in relevance.control_false_discoveries(df, level, independent).orderBy("i").collect()] == want


def test_false_discoveries_of_many_rows(spark):
    """Groups of any size, one of them without a name, in time that grows with the rows alone."""
    ms = [1, 2, 64, 65, 1000, 100_000]
    sums = spark.createDataFrame([(m,) for m in ms], "m long").select("m", relevance.harmonic(F.col("m")).alias("h")).collect()
    for r in sums:
        assert r["h"] == pytest.approx(math.fsum(1 / i for i in range(1, r["m"] + 1)), rel=1e-15)
    n = 150_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), F.pow(((F.col("id") * 7919) % 100_003) / 100_003, 3).alias("p_value"))
    start = time.monotonic()
    got = {r["id"] for r in relevance.control_false_discoveries(rows, 0.3, False, within="g").where("relevant").select("id").collect()}
    assert time.monotonic() - start < 60
    want = set()
    for g in (0, 1):
        ids = np.array([i for i in range(n) if (i % 3 > 0) == g])
        p = (((ids * 7919) % 100_003) / 100_003) ** 3
        order = np.sort(p)
        ok = order <= np.arange(1, len(p) + 1) * 0.3 / (len(p) * np.sum(1 / np.arange(1.0, len(p) + 1)))
        want |= set(ids[p <= order[ok].max()].tolist())
    assert 0 < len(want) < n and got == want

# --- pipelines


def test_pipelines(spark):
    rows = [(i, t, float(t % 3) + 3 * (i >= 30)) for i in range(50) for t in range(3)]
    series = spark.createDataFrame(rows, "id long, sort long, val double").withColumn("kind", F.lit("a"))
    y = spark.createDataFrame([(i, 5 if i >= 30 else 2) for i in range(50)], "id long, y int")
    columns = {"column_id": "id", "column_sort": "sort", "column_kind": "kind", "column_value": "val"}
    X = y.select("id")
    got = cf.extract_relevant_features(series, y, X, cf.MinimalFCParameters(), **columns)
    assert got.count() == 50 and "a__mean" in got.columns and "a__length" not in got.columns
    with pytest.raises(ValueError):
        cf.extract_relevant_features(series, y.where("id < 40"), None, cf.MinimalFCParameters(), **columns)
    assert cf.FeatureAugmenter(MEAN, **columns, timeseries_container=series).fit(X).transform(X).columns == ["id", "a__mean"]
    with pytest.raises(RuntimeError):
        cf.FeatureAugmenter().transform(X)
    with pytest.raises(AttributeError):
        cf.FeatureAugmenter(MEAN, **columns, timeseries_container=series).transform(X.withColumn("id", F.col("id") + 1000))
    both = cf.RelevantFeatureAugmenter(default_fc_parameters=cf.MinimalFCParameters(), **columns, timeseries_container=series).fit(X, y)
    out = both.transform(X)
    assert out.columns == ["id", *both.features] and out.where("a__mean is null").count() == 0 and "a__length" not in out.columns


# --- sources and streams


def test_text_sources(spark, tmp_path):
    (tmp_path / "plain.txt").write_text("1 2 3\n4 5 6\n")
    out = cli.main([str(tmp_path / "plain.txt"), "--settings", "minimal"])
    assert sorted(float(r["value__mean"]) for r in spark.read.option("header", True).csv(out).collect()) == [2.0, 5.0]
    (tmp_path / "head.txt").write_text("id t v\n1 1 2\n1 2 4\n2 1 7\n")
    out = cli.main([str(tmp_path / "head.txt"), "--with-header", "--column-id", "id", "--column-sort", "t", "--out", str(tmp_path / "o"), "--settings", "minimal"])
    assert {r["id"]: float(r["v__sum_values"]) for r in spark.read.option("header", True).csv(out).collect()} == {"1": 6.0, "2": 7.0}
    with pytest.raises(AttributeError):
        cli.main([str(tmp_path / "plain.txt"), "--column-id", "id"])
    (tmp_path / "blocks.txt").write_text("ok\n\t1\t2\n\t3\t4\n\nbad\n\t5\t6\n\n")
    series, labels = readers.read_blocks(spark, str(tmp_path / "blocks.txt"), ("a", "b"))
    assert sorted((r["time"], r["a"], r["b"]) for r in series.collect()) == [(0, 1.0, 2.0), (0, 5.0, 6.0), (1, 3.0, 4.0)] and {r["label"] for r in labels.collect()} == {"ok", "bad"}
    assert len(readers.read_wide_matrix(spark, str(tmp_path / "plain.txt")).first()["values"]) == 3


def test_simulated_series_have_the_expected_matrix(spark):
    series, y = readers.simulate_drift(spark, 20, 10)
    matrix = cf.extract_features(series, cf.MinimalFCParameters(), column_id="id", column_sort="time", column_kind="dimension", column_value="value")
    assert (matrix.count(), len(matrix.columns)) == (20, 21) and y.count() == 20


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, "k", i, float(i)) for i in range(100)], "id long, kind string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_features(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "kind", "ts", "v", "20 seconds")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    same = windowed_features(df, "id", "kind", "ts", "v", "20 seconds")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, same.collect()))
