"""The record operators: brute force on small tables, and the edges each docstring defines."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import hotkeys, lowrank, regrid, spikes, spread, trailing, widen

UTC = dt.timezone.utc


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, UTC)


# --- hot keys


def test_heavy_keys_count_all_rows_and_leave_out_null_keys(spark):
    rows = [(1, "a")] * 60 + [(None, "a")] * 30 + [(2, "b")] * 9 + [(3, None)]
    df = spark.createDataFrame(rows, "id long, kind string")
    assert [tuple(r)[:2] for r in hotkeys.heavy_keys(df, ["id", "kind"], 0.09).orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert hotkeys.heavy_keys(df.limit(0), ["id", "kind"], 0.01).count() == 0


def test_profile_equals_brute_force_across_cuts(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for key, n in (("hot", 700), ("cold", 3), ("one", 1)):
        values = [round(rng.uniform(-5, 5), 2) for _ in range(n)]
        for i, v in enumerate(values):
            bad = rng.random() < 0.1
            rows += [(key, i, float("nan") if bad else v, "x")] * rng.choice([1, 1, 2])
            if bad:
                values[i] = None
        truth[key] = (n, [v for v in values if v is not None])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, at long, head double, n_rows string")
    got = {r["id"]: r for r in hotkeys.ordered_profile(df, ["id"], "at", "head", partitions=7).collect()}
    for key, (n, v) in truth.items():
        r = got[key]
        assert (r["n_rows"], r["n_values"]) == (n, len(v))
        if v:
            mean = sum(v) / len(v)
            assert r["mean"] == pytest.approx(mean) and r["std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)))
            assert (r["first_value"], r["last_value"]) == (v[0], v[-1])
            assert r["absolute_sum_of_changes"] == pytest.approx(sum(abs(b - a) for a, b in zip(v, v[1:])))
            assert r["number_crossing_zero"] == sum((a > 0) != (b > 0) for a, b in zip(v, v[1:]))


def test_profile_of_a_key_without_values_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, None), (1, None, None), (None, 1, 2.0)], "id long, s long, v double")
    r = hotkeys.ordered_profile(df, ["id"], "s", "v").collect()
    assert len(r) == 1 and (r[0]["n_rows"], r[0]["n_values"], r[0]["mean"], r[0]["absolute_sum_of_changes"]) == (2, 0, None, None)
    assert hotkeys.ordered_profile(df.limit(0), ["id"], "s", "v").count() == 0


def test_halo_chunks_show_each_core_row_its_neighbours(spark):
    df = spark.createDataFrame([("a" if i < 80 else "b", i) for i in range(100)], "k string, i long")
    got = spread.halo_chunks(df, "k", ["i"], 3, partitions=6).collect()
    assert sorted(r["i"] for r in got if r["is_core"]) == list(range(100))
    by = {}
    for r in got:
        by.setdefault((r["k"], r["chunk"]), set()).add(r["i"])
    for r in got:
        if r["is_core"]:
            mine = range(80) if r["k"] == "a" else range(80, 100)
            assert {x for x in range(r["i"] - 3, r["i"] + 4) if x in mine} <= by[r["k"], r["chunk"]]


def test_salted_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (None, 51)], "g long, i long")
    per = rows.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = spread.salted_join(rows, per, ["g"], "n", ["i"])
    assert sorted((r["i"], r["n"]) for r in got.collect()) == [(i, 50) for i in range(50)] + [(50, 1), (51, None)]


# --- trailing totals


def test_trailing_totals_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for e in "ab":
        for _ in range(40):
            day = rng.randrange(0, 90)
            rows += [(e, at(day * 86400 + rng.randrange(86400)), round(rng.uniform(1, 9), 2), "x")] * rng.choice([1, 2])
    rows += [("a", at(0), None, "x"), ("a", at(0), float("nan"), "x"), (None, at(0), 1.0, "x"), ("c", None, 1.0, "x"), ("d", at(5 * 86400), 2.5, "y")]
    df = spark.createDataFrame(rows, "who string, day_total timestamp, day double, bucket string")
    for bucket in (None, 4):
        got = {(r["who"], r["day"]): r for r in trailing.trailing_totals(df, "who", "day_total", "day", (7, 30), bucket).collect()}
        kept = {(w, t, v) for w, t, v, _ in rows if w and t and v is not None and v == v}
        days = {}
        for w, t, v in kept:
            days.setdefault(w, {}).setdefault(int(t.timestamp() // 86400), []).append(v)
        assert len(got) == sum(max(x) - min(x) + 1 for x in days.values())
        for (w, d), r in got.items():
            for p in (7, 30):
                v = [x for k, xs in days[w].items() if d - p < k <= d for x in xs]
                assert r[f"rows_{p}"] == len(v) and r[f"total_{p}"] == pytest.approx(sum(v))
                assert (r[f"average_{p}"] is None) == (not v)
    assert trailing.trailing_totals(df.limit(0), "who", "day_total", "day").count() == 0


# --- widening

TYPES = [("b", "boolean"), ("n", "bigint"), ("d", "double")]


@pytest.mark.parametrize(
    "variable,values,value,issue",
    [
        ("b", ["yes", " TRUE\t", "1.0", "1e0"], True, None),
        ("b", ["no", "2"], False, None),
        ("b", ["2"], None, "unreadable"),
        ("b", ["t", "F"], False, "conflict"),
        ("n", ["32.000", "+3,2e1", "0032"], 32, None),
        ("n", ["1.5"], None, "unreadable"),
        ("n", ["9223372036854775807"], 9223372036854775807, None),
        ("n", ["1e30"], None, "unreadable"),
        ("d", ["5,1", "5.10", "+5.1e0"], 5.1, None),
        ("d", ["-Infinity"], float("-inf"), None),
        ("d", ["1.2.3", None, "nan"], None, "unreadable"),
        ("d", ["", None, " None ", "NA"], None, None),
        ("d", ["0", "-0.0"], 0.0, None),
        ("d", ["1", "x", "2"], 2.0, "conflict"),
    ],
)
def test_cells(spark, variable, values, value, issue):
    rows = [(7, variable, v, at(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "column_id long, variable string, value string, loaded_at timestamp")
    wide = widen.widen(df, spark.createDataFrame(TYPES, "variable string, dtype string"), flags=True)
    r = wide.collect()[0]
    assert (r[variable]["value"] if r[variable] else None) == value
    assert [tuple(x) for x in widen.cell_issues(wide).collect()] == ([(7, variable, issue)] if issue else [])


def test_widen_keeps_every_entity(spark):
    types = spark.createDataFrame([*TYPES, ("odd.`name", "double")], "variable string, dtype string")
    rows = [(1, "d", "1", at(0)), (2, "unlisted", "1", at(0)), (3, None, None, None), (None, "d", "1", at(0)), (4, "odd.`name", "2", None)]
    df = spark.createDataFrame(rows, "column_id long, variable string, value string, loaded_at timestamp").withColumn("_raw", F.lit("clash"))
    wide = widen.widen(df, types)
    assert wide.columns == ["column_id", "b", "d", "n", "odd.`name"]
    assert sorted(tuple(r) for r in wide.collect())[0] == (1, None, 1.0, None, None)
    assert {r[0]: r[4] for r in wide.collect()} == {1: None, 2: None, 3: None, 4: 2.0}
    assert widen.widen(df.limit(0), types).count() == 0
    assert widen.widen(df, types.limit(0)).columns == ["column_id"]
    with pytest.raises(ValueError):
        widen.widen(df, spark.createDataFrame([("x", "text")], "variable string, dtype string"))


# --- filling


def _matrix(spark, n=240):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(n):
        g = i % 8
        u = rng.gauss(0, 1)
        x, y = 10 * g + 3 * u + rng.gauss(0, 0.2), 5 * g - 2 * u + rng.gauss(0, 0.2)
        c = "hi" if u > 0 else "lo"
        truth[i] = (x, y, c)
        drop = rng.random()
        rows.append((i, f"g{g}", at(86400 * (i % 5)), -9999.0 if drop < 0.1 else x, float("inf") if 0.1 < drop < 0.2 else y, " N/A" if 0.2 < drop < 0.3 else c, at(i)))
    return rows, truth


def test_filling_beats_the_group_mean_and_marks_cells(spark):
    rows, truth = _matrix(spark)
    df = spark.createDataFrame(rows + rows[:20], "id long, grp string, t timestamp, x double, y double, c string, loaded timestamp")
    got = lowrank.fill_from_similar(df, "grp", "t", ["x", "y"], ["c"], "loaded", ["id"], rank=2, passes=10, ridge=0.1).collect()
    assert len(got) == len(rows)
    error, plain, right = [], [], []
    for r in got:
        raw = rows[r["id"]]
        want = {k for k, bad in (("x", raw[3] == -9999.0), ("y", math.isinf(raw[4])), ("c", raw[5] == " N/A")) if bad}
        assert set(r["filled"]) == want and set(r["filled"].values()) <= {"group"}
        same = [k for k in truth if k % 8 == r["id"] % 8]
        for k, i in (("x", 0), ("y", 1)):
            if k in want:
                error.append(abs(r[k] - truth[r["id"]][i]))
                plain.append(abs(sum(truth[s][i] for s in same) / len(same) - truth[r["id"]][i]))
        if "c" in want:
            right.append(r["c"] == truth[r["id"]][2])
    assert sum(error) < 0.6 * sum(plain)
    assert sum(right) > 0.7 * len(right)


def test_filling_scopes_and_edges(spark):
    rows = [(1, "a", at(0), None, "k", at(0)), (2, "a", at(0), None, None, at(0)), (3, "b", at(0), 4.0, "m", at(0)), (4, None, None, None, None, at(0)), (5, "b", at(0), 0.0, "?", at(0))]
    df = spark.createDataFrame(rows, "id long, grp string, t timestamp, fit double, cells string, loaded timestamp")
    got = {r["id"]: r for r in lowrank.fill_from_similar(df, "grp", "t", ["fit"], ["cells"], "loaded", ["id"]).collect()}
    assert {k: v["filled"] for k, v in got.items()} == {1: {"fit": "day"}, 2: {"fit": "day", "cells": "group"}, 3: {}, 4: {"fit": "all", "cells": "all"}, 5: {"cells": "group"}}
    assert got[5]["fit"] == 0.0 and got[5]["cells"] in ("k", "m") and 0 <= got[1]["fit"] <= 4
    empty = lowrank.fill_from_similar(df.limit(0), "grp", "t", ["fit"], ["cells"], "loaded", ["id"])
    assert empty.count() == 0 and empty.columns == [*df.columns, "filled"]
    nothing = lowrank.fill_from_similar(df.where("id = 2"), "grp", "t", ["fit"], ["cells"], "loaded", ["id"]).collect()[0]
    assert nothing["filled"] == {"fit": "none", "cells": "none"} or nothing["filled"] == {"fit": "none", "cells": "all"}
    assert nothing["fit"] is None and nothing["cells"] is None


def test_text_with_many_values_takes_the_groups_mode(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "MOST_CATEGORIES", 3)
    rows = [(i, "g", at(0), f"name {i % 5}", float(i)) for i in range(10)] + [(20, "g", at(0), "name 2", 1.0), (21, "g", at(0), None, None), (22, "other", at(0), "?", 2.0), (23, None, at(9e6), None, 3.0)]
    df = spark.createDataFrame(rows, "id long, grp string, snap_time timestamp, who string, n double").withColumn("loaded_at", F.lit(None).cast("timestamp"))
    got = {r["id"]: r for r in lowrank.fill_from_similar(df, "grp", "snap_time", ["n"], ["who"], "loaded_at", ["id"]).collect()}
    assert got[21]["who"] == "name 2" and got[21]["filled"]["who"] == "group" and got[21]["filled"]["n"] == "group"
    assert got[22]["who"] == "name 2" and got[22]["filled"] == {"who": "day"} and got[23]["filled"] == {"who": "all"}
    only = lowrank.fill_from_similar(df.drop("n"), "grp", "snap_time", [], ["who"], "loaded_at", ["id"]).collect()
    assert len(only) == 14 and all(r["who"] for r in only)


# --- implausible readings


def _readings(spark):
    rng = random.Random(4)
    rows, spikes_, stuck = [], set(), set()
    rid = 0
    for s in range(3):
        v = 100.0
        for i in range(300):
            v += rng.choice([-1, 1]) * rng.uniform(0.5, 1.5)
            x = v
            if s == 0 and i in (50, 51, 200):
                x, _ = v + 60, spikes_.add(rid)
            if s == 1 and 100 <= i < 115:
                x, _ = 77.7 + 40, stuck.add(rid)
            if s == 2:
                x = float(round(v / 20) * 20)
            rows.append((rid, s, at(1000 + 60 * i), x, "z"))
            rid += 1
    rows += [(rid, 0, at(5), -1e6, "z"), (rid + 1, 0, None, 1.0, "z"), (rid + 2, 0, at(7), None, "z"), (rid + 3, 9, at(1), 5.0, "z"), (None, 0, at(9), 5.0, "z"), (rid + 4, 0, at(99_999), float("inf"), "z")]
    return rows, spikes_, stuck, rid


def test_spikes_stuck_runs_and_limits(spark):
    rows, spiked, stuck, rid = _readings(spark)
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows + rows[:50], "reading_id long, id long, time timestamp, value double, _v string")
    sensors = spark.createDataFrame([(0, -1e4, 1e4), (1, -1e4, 1e4), (2, None, None)], "id long, lo double, hi double")
    got = {r["reading_id"]: r for r in spikes.flag_readings(df, sensors).collect()}
    assert len(got) == 900 + 3 and all(0 < r["score"] < 1 for r in got.values())
    assert {k for k, r in got.items() if r["spike"]} == spiked
    assert {k for k, r in got.items() if r["stuck"]} == stuck
    assert {k for k, r in got.items() if r["impossible"]} == {rid, rid + 4}
    assert spikes.flag_readings(df.limit(0), sensors).count() == 0


def test_candidates_are_few_and_hold_every_case(spark):
    rows, spiked, stuck, _ = _readings(spark)
    df = spark.createDataFrame(rows, "reading_id long, id long, time timestamp, value double, _v string")
    sensors = spark.createDataFrame([(0, -1e4, 1e4), (1, -1e4, 1e4), (2, None, None)], "id long, lo double, hi double")
    got = spikes.flag_readings(df, sensors).collect()
    chosen = {r["reading_id"] for r in got if r["candidate"]}
    assert spiked | stuck <= chosen and len(chosen) < 0.25 * len(got)
    # The threshold is the source's own.
    assert len({(r["id"], r["threshold"]) for r in got}) == 4 == len({r["threshold"] for r in got})


def test_slices_of_a_hot_source_grow_the_same_forest(spark, monkeypatch):
    rows, _, _, _ = _readings(spark)
    df = spark.createDataFrame(rows, "reading_id long, id long, time timestamp, value double, _v string")
    sensors = spark.createDataFrame([(0, -1e4, 1e4), (1, -1e4, 1e4), (2, None, None)], "id long, lo double, hi double")
    whole = {r["reading_id"]: tuple(r) for r in spikes.flag_readings(df, sensors).collect()}
    monkeypatch.setattr(spikes, "SLICE", 64)
    sliced = spikes.flag_readings(df, sensors).collect()
    assert {r["reading_id"]: tuple(r) for r in sliced} == whole and len(sliced) == len(whole)


def test_many_ranges_still_give_full_halos(spark):
    df = spark.createDataFrame([(1, i) for i in range(60)], "k int, i long")
    got = spread.halo_chunks(df, "k", ["i"], 12, partitions=40).collect()
    of = {}
    for r in got:
        of.setdefault(r["chunk"], []).append((r["i"], r["is_core"]))
    for members in of.values():
        here = {i for i, _ in members}
        for i in (i for i, core in members if core):
            assert {j for j in range(i - 12, i + 13) if 0 <= j < 60} <= here


def test_forest_scores_outliers_high():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 2)), [[9, 9]]])
    s = spikes.IsolationForest(x, 1, trees=64).score(x)
    assert s[-1] == s.max() and s[-1] > 0.65 and np.median(s) < 0.5
    assert np.isfinite(spikes.IsolationForest(x[:1], 1).score(x[:3])).all()


@pytest.mark.parametrize("rows_of_a_task", [None, 700])
def test_every_run_of_a_source_grows_its_forest(spark, monkeypatch, rows_of_a_task):
    # One reading in 3,000 differs, in one feature and by little: only a forest grown on it can tell it from the others.
    n, rare = 3000, {s: 3000 * s + 411 * s + 7 for s in range(6)}
    rows = [(n * s + i, s, True, 0.0, 0.0, 3.0 if n * s + i == rare[s] else 0.0, 0.0, n, n) for s in rare for i in range(n)]
    df = spark.createDataFrame(rows, "_r long, _s long, _starts boolean, f_level double, f_difference double, f_season double, f_run double, _n long, _g long")
    if rows_of_a_task:
        monkeypatch.setattr(spikes, "SLICE", rows_of_a_task)
    got = {r["_r"]: (r["_s"], r["score"]) for r in spikes.forest_scores(df).collect()}
    assert len(got) == n * len(rare)
    for s, r in rare.items():
        others = {score for of, score in got.values() if of == s} - {got[r][1]}
        assert len(others) == 1 and got[r][1] > others.pop()


def test_the_usual_change_of_a_large_source_is_exact(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    v = rng.laplace(0, 1, 60_000)
    v[30_000] += 50
    df = spark.createDataFrame(pd.DataFrame({"reading_id": np.arange(len(v)), "id": 1, "time": pd.to_datetime(60 * np.arange(len(v)), unit="s", utc=True), "value": v}))
    sensors = spark.createDataFrame([(1, None, None)], "id long, lo double, hi double")
    size = spikes.reading_features(df, sensors).where("_r = 30000").first()["size"]
    changes = np.sort(np.abs(np.diff(v)))
    assert size == min(v[30_000] - v[29_999], v[30_000] - v[30_001]) / changes[(len(changes) + 1) // 2 - 1]


# --- regular grid


def test_readings_without_an_id_stay_apart(spark):
    rows = [(None, 1, at(30), 1.0), (None, 1, at(90), 2.0), (None, 1, at(90), 2.0), (None, 2, at(30), 3.0), (7, 1, at(150), 4.0)]
    df = spark.createDataFrame(rows, "reading_id long, id long, time timestamp, value double")
    got = {(r["id"], r["slot_epoch"]): r["n_readings"] for r in regrid.regular_grid(df, spark.createDataFrame([(1, 60), (2, 60)], "id long, step_s int")).collect()}
    assert got == {(1, 0): 1, (1, 60): 1, (1, 120): 1, (2, 0): 1}


def test_grid_slots_and_estimates(spark):
    rows = [(i, 1, at(60 * i + 30), 2.0 * i, "q") for i in range(10) if i not in (4, 5)] + [(100, 1, at(60 * 30 + 1), 7.0, "q"), (101, 1, None, 1.0, "q"), (102, 1, at(60 * 20), float("nan"), "q"), (103, None, at(1), 1.0, "q"), (104, 5, at(1), 1.0, "q"), (105, 2, at(-61), 3.0, "q")]
    df = spark.createDataFrame(rows + rows[:5], "reading_id long, id long, time timestamp, value double, support string")
    sensors = spark.createDataFrame([(1, 60), (2, 60), (5, 0)], "id long, step_s int")
    got = {(r["id"], r["slot_epoch"]): r for r in regrid.regular_grid(df, sensors).collect()}
    assert sorted(k for k in got if k[0] == 1) == [(1, 60 * k) for k in range(31)] and (2, -120) in got and not any(k[0] == 5 for k in got)
    assert got[1, 240]["status"] == "filled" and got[1, 240]["value"] == pytest.approx(8.0, abs=1e-6)
    assert got[1, 120]["n_readings"] == 1 and got[1, 120]["value"] == pytest.approx(4.0, abs=1e-6)
    assert got[1, 60 * 20]["status"] == "missing" and got[1, 60 * 20]["value"] is None
    assert regrid.regular_grid(df.limit(0), sensors).count() == 0
