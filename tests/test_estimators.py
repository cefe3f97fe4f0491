"""The stages in a pipeline: fit, transform, save and load."""

import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

import chronofold as cf
from chronofold.functions import settings
from chronofold.operators import relevance
from chronofold.plans import estimators as es
from chronofold.plans.extract import extract_features

COLUMNS = {"column_id": "sid", "column_sort": "t", "column_kind": "kind", "column_value": "v"}


def _series(spark):
    rows = [(i, t, k, float((i % 2) * 10 * (k == "a") + (7 * i + 3 * t) % 5)) for i in range(30) for t in range(6) for k in "ab"]
    return spark.createDataFrame(rows, "sid long, t long, kind string, v double"), spark.createDataFrame([(i, float(i % 2), "x") for i in range(30)], "id long, y double, note string")


def test_stages_in_a_pipeline(spark, tmp_path):
    series, frame = _series(spark)
    stages = [es.AugmentFeatures(series=series, fc_parameters=settings.MinimalFCParameters(), **COLUMNS), es.ImputePerColumn(), es.SelectFeatures()]
    model = Pipeline(stages=stages).fit(frame.drop("note"))
    out = model.transform(frame.drop("note"))
    assert {"id", "y", "a__mean", "a__maximum"} <= set(out.columns) and "b__length" not in out.columns and out.count() == 30
    last = model.stages[-1]
    last.write().overwrite().save(str(tmp_path / "selector"))
    again = es.SelectFeaturesModel.load(str(tmp_path / "selector"))
    assert again.relevant_features == last.relevant_features


def test_relevant_features_of_new_ids(spark, tmp_path):
    series, frame = _series(spark)
    model = es.AugmentRelevantFeatures(series=series, fc_parameters={"mean": None, "length": None}, columns=COLUMNS).fit(frame.where("id < 20"))
    assert model.relevant_features == ["a__mean"]
    new = model.transform(frame.where("id >= 20").drop("y"))
    assert set(new.columns) == {"id", "note", "a__mean"} and new.count() == 10
    model.save(str(tmp_path / "m"))
    again = es.AugmentRelevantFeaturesModel.load(str(tmp_path / "m"))
    with pytest.raises(RuntimeError):
        again.transform(frame)
    assert sorted(map(tuple, again.setSeries(series).transform(frame).select("id", "a__mean").collect())) == sorted(map(tuple, model.transform(frame).select("id", "a__mean").collect()))


def test_ids_must_agree_and_options_be_known(spark):
    X = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, f double")
    y = spark.createDataFrame([(1, 0.0), (3, 1.0)], "id long, y double")
    with pytest.raises(ValueError, match="same ids"):
        cf.calculate_relevance_table(X, y)
    with pytest.raises(ValueError, match="same ids"):
        relevance.check_alignment(X, y.unionByName(y))
    with pytest.raises(TypeError):
        cf.calculate_relevance_table(X, X.withColumnRenamed("f", "y"), fdr_levle=0.1)
    with pytest.raises(ValueError):
        cf.calculate_relevance_table(X, X.withColumnRenamed("f", "y"), test_for_real_target_real_feature="pearson")
    with pytest.raises(TypeError):
        extract_features(X, {"mean": None}, column_id="id", sort="t")


def test_forms_and_custom_calculators(spark):
    def ends(x, param):
        return [(f"side_{p['side']}", x[0] if p["side"] == "first" else x[-1]) for p in param]

    def hours(x):
        return (x.index[-1] - x.index[0]).total_seconds() / 3600

    ends.fctype = "combiner"
    hours.input = "pd.Series"
    pdf = pd.DataFrame({"id": [1, 1, 2], "t": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-01"]), "a": [3.0, 5.0, 7.0]})
    chosen = {ends: [{"side": "first"}, {"side": "last"}], hours: None, "maximum": None}
    got = {r["id"]: r.asDict() for r in extract_features(pdf, chosen, column_id="id", column_sort="t", column_time="t").collect()}
    assert got[1] == {"id": 1, 'a__ends__side_"first"': 3.0, 'a__ends__side_"last"': 5.0, "a__hours": 24.0, "a__maximum": 5.0} and got[2]["a__hours"] == 0.0
    assert settings.include_function("mean") and not settings.include_function("sample_entropy", "high_comp_cost") and not settings.include_function("nothing")


def test_kinds_with_settings_of_their_own_share_a_frame(spark):
    series, _ = _series(spark)
    per_kind = {"a": {"length": None, "sample_entropy": None}, "b": {"maximum": None}}
    long = extract_features(series, {"mean": None}, per_kind, pivot=False, **COLUMNS)
    assert {r[0] for r in long.select("variable").distinct().collect()} == {"a__length", "a__sample_entropy", "b__maximum"}
    wide = extract_features(series, None, per_kind, **COLUMNS)
    assert wide.columns == ["id", "a__length", "a__sample_entropy", "b__maximum"] and wide.where(F.col("a__length") == 6).count() == 30
    mixed = extract_features(series, {"mean": None, "lempel_ziv_complexity": [{"bins": 3}]}, {"a": {"lempel_ziv_complexity": [{"bins": 2}]}}, **COLUMNS)
    assert mixed.columns == ["id", "a__lempel_ziv_complexity__bins_2", "b__mean", "b__lempel_ziv_complexity__bins_3"]
    assert mixed.where(" or ".join(f"`{c}` is null" for c in mixed.columns)).isEmpty()
