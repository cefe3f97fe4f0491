"""The augmenters, the selector and the imputer as stages of a ``pyspark.ml`` Pipeline.

A stage works on one frame of ids: ``idCol`` names the id and ``labelCol`` the target, which only ``fit`` needs. Fitted stages can be saved and loaded;
the series are no part of what is saved and are given again with ``setSeries``.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from chronofold.functions import settings
from chronofold.operators import impute as imp
from chronofold.plans import pipeline
from chronofold.plans.container import Container
from chronofold.plans.extract import extract_features

COLUMNS = ("column_id", "column_sort", "column_kind", "column_value", "column_time")


class _Ids(Params):
    idCol = Param(Params._dummy(), "idCol", "column of ids", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column of the target; only fit needs it", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "options of the selection, as JSON", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "what was fitted, as JSON", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(idCol="id", labelCol="y", options="{}", state="{}")

    def _option(self, name: str) -> object:
        return json.loads(self.getOrDefault(self.options)).get(name)

    def _fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def _split(self, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The frame with ``id`` and without the target, and the target as (id, y)."""
        key, label = self.getOrDefault(self.idCol), self.getOrDefault(self.labelCol)
        y = dataset.select(pipeline._q(key).alias("id"), pipeline._q(label).alias("y"))
        return self._keyed(dataset.drop(label)), y

    def _keyed(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.idCol)
        return dataset if key == "id" else dataset.withColumnRenamed(key, "id")

    def _back(self, out: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.idCol)
        return out if key == "id" else out.withColumnRenamed("id", key)


class _Series(_Ids):
    """Stages that read series: ``columns`` says how, ``settings`` which features (names of calculators; None: all)."""

    series: Container | None = None
    fc_parameters: dict | None = None

    def setSeries(self, series: Container) -> _Series:
        self.series = series
        return self

    def _columns(self) -> dict:
        return {k: v for k, v in (self._option("columns") or {}).items() if k in COLUMNS}

    def _need(self) -> Container:
        if self.series is None:
            raise RuntimeError("there are no series: setSeries comes first")
        return self.series

    def copy(self, extra: dict | None = None) -> _Series:
        other = super().copy(extra)
        other.series, other.fc_parameters = self.series, self.fc_parameters
        return other


class AugmentFeatures(Transformer, _Series, DefaultParamsReadable, DefaultParamsWritable):
    """Joins all features of the series to a frame of ids."""

    def __init__(self, idCol: str = "id", series: Container | None = None, fc_parameters: dict | None = None, **columns: object) -> None:
        super().__init__()
        self._defaults()
        self._set(idCol=idCol, options=json.dumps({"columns": columns}))
        self.series, self.fc_parameters = series, fc_parameters

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stage = pipeline.FeatureAugmenter(self.fc_parameters, timeseries_container=self._need(), **self._columns())
        return self._back(stage.transform(self._keyed(dataset)))


class SelectFeatures(Estimator, _Ids, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the columns that are relevant for the target."""

    def __init__(self, idCol: str = "id", labelCol: str = "y", **options: object) -> None:
        super().__init__()
        self._defaults()
        self._set(idCol=idCol, labelCol=labelCol, options=json.dumps(options))

    def _fit(self, dataset: DataFrame) -> SelectFeaturesModel:
        X, y = self._split(dataset)
        stage = pipeline.FeatureSelector(**json.loads(self.getOrDefault(self.options))).fit(X, y)
        model = SelectFeaturesModel(self.getOrDefault(self.idCol), self.getOrDefault(self.labelCol))
        return model._set(state=json.dumps({"features": stage.relevant_features, "p_values": stage.p_values}))


class SelectFeaturesModel(Model, _Ids, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, idCol: str = "id", labelCol: str = "y") -> None:
        super().__init__()
        self._defaults()
        self._set(idCol=idCol, labelCol=labelCol)

    @property
    def relevant_features(self) -> list[str]:
        return self._fitted()["features"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [c for c in (self.getOrDefault(self.idCol), self.getOrDefault(self.labelCol)) if c in dataset.columns]
        return dataset.select(*map(pipeline._q, [*keep, *self.relevant_features]))


class ImputePerColumn(Estimator, _Ids, DefaultParamsReadable, DefaultParamsWritable):
    """Learns each column's range and median, and replaces values that are not finite by them."""

    @keyword_only
    def __init__(self, *, idCol: str = "id", labelCol: str = "y") -> None:
        super().__init__()
        self._defaults()
        self._set(idCol=idCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> ImputePerColumnModel:
        columns = [c for c in imp.number_columns(dataset) if c not in (self.getOrDefault(self.idCol), self.getOrDefault(self.labelCol))]
        ranges = imp.get_range_values_per_column(dataset, columns)
        return ImputePerColumnModel()._set(idCol=self.getOrDefault(self.idCol), state=json.dumps({"ranges": ranges}))


class ImputePerColumnModel(Model, _Ids, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self) -> None:
        super().__init__()
        self._defaults()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ranges = self._fitted()["ranges"]
        return imp.impute_dataframe_range(dataset, *ranges, columns=list(ranges[0]))


class AugmentRelevantFeatures(Estimator, _Series, DefaultParamsReadable, DefaultParamsWritable):
    """Extracts all features of the training ids and learns which matter; the model extracts only those."""

    def __init__(self, idCol: str = "id", labelCol: str = "y", series: Container | None = None, fc_parameters: dict | None = None, columns: dict | None = None, **selection: object) -> None:
        super().__init__()
        self._defaults()
        self._set(idCol=idCol, labelCol=labelCol, options=json.dumps({"columns": columns or {}, "selection": selection}))
        self.series, self.fc_parameters = series, fc_parameters

    def _fit(self, dataset: DataFrame) -> AugmentRelevantFeaturesModel:
        X, y = self._split(dataset)
        stage = pipeline.RelevantFeatureAugmenter(default_fc_parameters=self.fc_parameters, timeseries_container=self._need(), **self._columns(), **(self._option("selection") or {})).fit(X, y)
        model = AugmentRelevantFeaturesModel(series=self.series)
        return model._set(idCol=self.getOrDefault(self.idCol), options=self.getOrDefault(self.options), state=json.dumps({"features": stage.features, "ranges": stage.ranges}))


class AugmentRelevantFeaturesModel(Model, _Series, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, series: Container | None = None) -> None:
        super().__init__()
        self._defaults()
        self.series = series

    @property
    def relevant_features(self) -> list[str]:
        return self._fitted()["features"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted, columns, X = self._fitted(), self._columns(), self._keyed(dataset)
        if not fitted["features"]:
            return dataset
        rows = imp.restrict_input_to_index(self._need(), columns.get("column_id", "id"), X)
        matrix = extract_features(rows, {}, settings.from_columns(fitted["features"]), **columns).select("id", *map(pipeline._q, fitted["features"]))
        return self._back(X.join(imp.impute_dataframe_range(matrix, *fitted["ranges"]), "id", "left"))
