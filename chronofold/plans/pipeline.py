"""Extraction and selection together, and estimators with fit and transform."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions import settings
from chronofold.operators import impute as imp
from chronofold.operators import relevance
from chronofold.plans.container import Container
from chronofold.plans.extract import extract_features


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _ids_of(container: Container, column_id: str) -> DataFrame:
    return imp.get_ids(container, column_id)


def extract_relevant_features(
    timeseries_container: Container,
    y: DataFrame,
    X: DataFrame | None = None,
    default_fc_parameters: Mapping | None = None,
    kind_to_fc_parameters: Mapping | None = None,
    column_id: str = "id",
    column_sort: str | list[str] | None = None,
    column_kind: str | None = None,
    column_value: str | None = None,
    column_time: str | None = None,
    **selection: object,
) -> DataFrame:
    """Extract, impute, keep what is relevant for ``y`` (id, y), and join it to ``X`` (with ``id``) if given."""
    if y.agg(F.countDistinct("y")).collect()[0][0] < 2:
        raise AssertionError("the target has one value only")
    if X is not None:
        timeseries_container = imp.restrict_input_to_index(timeseries_container, column_id, X)
    have, want = _ids_of(timeseries_container, column_id), y.select("id").distinct()
    for a, b, what in ((have, want, "in the series but not in y"), (want, have, "in y but not in the series")):
        if some := a.join(b, "id", "left_anti").limit(5).collect():
            raise ValueError(f"ids {what}, such as {[r[0] for r in some]}")
    matrix = extract_features(timeseries_container, default_fc_parameters, kind_to_fc_parameters, column_id, column_sort, column_kind, column_value, column_time, impute_function=imp.impute)
    kept = relevance.select_features(matrix, y, **selection)
    return X.join(kept, "id", "left") if X is not None else kept


class _NotFitted(ValueError):
    """fit comes before transform."""


class PerColumnImputer:
    """Replaces values that are not finite by the ranges of the frame it was fitted on, or by presets per column."""

    def __init__(self, col_to_NINF_repl_preset: Mapping[str, float] | None = None, col_to_PINF_repl_preset: Mapping[str, float] | None = None, col_to_NAN_repl_preset: Mapping[str, float] | None = None) -> None:
        self.presets = (col_to_PINF_repl_preset, col_to_NINF_repl_preset, col_to_NAN_repl_preset)
        self.ranges: tuple[dict[str, float], ...] | None = None

    def fit(self, X: DataFrame, y: DataFrame | None = None) -> PerColumnImputer:
        columns = imp.number_columns(X)
        for given in self.presets:
            if given and (unknown := set(given) - set(columns)):
                raise ValueError(f"presets for unknown columns {sorted(unknown)}")
        self.ranges = tuple(found | dict(given or {}) for found, given in zip(imp.get_range_values_per_column(X, columns), self.presets))
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        if self.ranges is None:
            raise _NotFitted("the imputer is not fitted")
        return imp.impute_dataframe_range(X, *self.ranges)


class FeatureAugmenter:
    """Joins the features of the series to a frame of ids."""

    def __init__(self, default_fc_parameters: Mapping | None = None, kind_to_fc_parameters: Mapping | None = None, column_id: str = "id", column_sort: str | list[str] | None = None, column_kind: str | None = None, column_value: str | None = None, column_time: str | None = None, timeseries_container: Container | None = None) -> None:
        self.settings = (default_fc_parameters, kind_to_fc_parameters)
        self.columns = {"column_id": column_id, "column_sort": column_sort, "column_kind": column_kind, "column_value": column_value, "column_time": column_time}
        self.timeseries_container = timeseries_container

    def set_timeseries_container(self, container: Container) -> FeatureAugmenter:
        self.timeseries_container = container
        return self

    def fit(self, X: DataFrame | None = None, y: DataFrame | None = None) -> FeatureAugmenter:
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        if self.timeseries_container is None:
            raise RuntimeError("there are no series: set_timeseries_container comes first")
        rows = imp.restrict_input_to_index(self.timeseries_container, self.columns["column_id"], X)
        return X.join(extract_features(rows, *self.settings, **self.columns), "id", "left")


class FeatureSelector:
    """Keeps the columns that were relevant when it was fitted."""

    def __init__(self, multiclass_p_values: str = "min", multiclass: bool = False, n_significant: int = 1, **options: object) -> None:
        if multiclass_p_values not in ("min", "max", "avg", "all"):
            raise ValueError("multiclass_p_values must be min, max, avg or all")
        self.options = options | {"multiclass": multiclass, "n_significant": n_significant}
        self.multiclass_p_values = multiclass_p_values
        self.relevant_features: list[str] | None = None
        self.p_values: dict[str, object] = {}
        self.feature_importances_: dict[str, object] = {}

    def fit(self, X: DataFrame, y: DataFrame) -> FeatureSelector:
        rows = [r.asDict() for r in relevance.calculate_relevance_table(X, y, **self.options).orderBy("feature").collect()]
        self.relevant_features = [r["feature"] for r in rows if r["relevant"]]
        for r in rows:
            ps = {k.removeprefix("p_value_"): v for k, v in r.items() if k.startswith("p_value_")}
            if not ps:
                self.p_values[r["feature"]] = r["p_value"]
                self.feature_importances_[r["feature"]] = None if r["p_value"] is None else 1.0 - r["p_value"]
                continue
            known = [v for v in ps.values() if v is not None]
            if self.multiclass_p_values == "all":
                self.p_values[r["feature"]] = ps
                self.feature_importances_[r["feature"]] = {k: None if v is None else 1.0 - v for k, v in ps.items()}
                continue
            p = {"min": min, "max": max, "avg": lambda v: sum(v) / len(v)}[self.multiclass_p_values](known) if known else None
            self.p_values[r["feature"]] = p
            self.feature_importances_[r["feature"]] = None if p is None else 1.0 - p ** r["n_significant"]
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        if self.relevant_features is None:
            raise _NotFitted("the selector is not fitted")
        return X.select("id", *[_q(c) for c in self.relevant_features])


class RelevantFeatureAugmenter:
    """Fit: extract all features and select. Transform: extract only the selected ones, impute them as in training, and join."""

    def __init__(self, filter_only_extracted: bool = True, default_fc_parameters: Mapping | None = None, kind_to_fc_parameters: Mapping | None = None, column_id: str = "id", column_sort: str | list[str] | None = None, column_kind: str | None = None, column_value: str | None = None, column_time: str | None = None, timeseries_container: Container | None = None, **selection: object) -> None:
        self.augmenter = FeatureAugmenter(default_fc_parameters, kind_to_fc_parameters, column_id, column_sort, column_kind, column_value, column_time, timeseries_container)
        self.filter_only_extracted = filter_only_extracted
        self.selector = FeatureSelector(**selection)
        self.features: list[str] | None = None
        self.columns: list[str] = []
        self.ranges: tuple[dict[str, float], ...] = ({}, {}, {})

    def set_timeseries_container(self, container: Container) -> RelevantFeatureAugmenter:
        self.augmenter.set_timeseries_container(container)
        return self

    def fit(self, X: DataFrame, y: DataFrame) -> RelevantFeatureAugmenter:
        if self.augmenter.timeseries_container is None:
            raise RuntimeError("there are no series: set_timeseries_container comes first")
        columns = self.augmenter.columns
        rows = imp.restrict_input_to_index(self.augmenter.timeseries_container, columns["column_id"], X)
        matrix = extract_features(rows, *self.augmenter.settings, **columns)
        ranges = imp.get_range_values_per_column(matrix)
        matrix = imp.impute_dataframe_range(matrix, *ranges)
        pool = matrix if self.filter_only_extracted else X.join(matrix, "id", "left")
        self.selector.fit(pool, y)
        extracted = set(matrix.columns) - {"id"}
        self.features = [c for c in self.selector.relevant_features if c in extracted]
        self.columns = [c for c in X.columns if c != "id" and (self.filter_only_extracted or c in self.selector.relevant_features)]
        self.ranges = tuple({c: r[c] for c in self.features} for r in ranges)
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        if self.features is None:
            raise _NotFitted("the augmenter is not fitted")
        base = X.select("id", *[_q(c) for c in self.columns])
        if not self.features:
            return base
        columns = self.augmenter.columns
        rows = imp.restrict_input_to_index(self.augmenter.timeseries_container, columns["column_id"], X)
        wanted = settings.from_columns(self.features)
        matrix = extract_features(rows, {}, wanted, **columns).select("id", *[_q(c) for c in self.features])
        return base.join(imp.impute_dataframe_range(matrix, *self.ranges), "id", "left")
