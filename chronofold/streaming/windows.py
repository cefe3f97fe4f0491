"""Algebraic features of time windows on a stream, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features whose state is a few numbers per window and series.
ALGEBRAIC = {
    "sum_values": lambda v: F.sum(v),
    "length": lambda v: F.count(v).cast("double"),
    "mean": lambda v: F.avg(v),
    "variance": lambda v: F.var_pop(v),
    "standard_deviation": lambda v: F.stddev_pop(v),
    "abs_energy": lambda v: F.sum(v * v),
    "root_mean_square": lambda v: F.sqrt(F.avg(v * v)),
    "maximum": lambda v: F.max(v),
    "minimum": lambda v: F.min(v),
    "absolute_maximum": lambda v: F.max(F.abs(v)),
}


def windowed_features(stream: DataFrame, column_id: str, column_kind: str, column_time: str, column_value: str, window: str, slide: str | None = None, watermark: str = "10 minutes", features: tuple[str, ...] = tuple(ALGEBRAIC)) -> DataFrame:
    """(start, end, id, kind, features...) per window of every series. Works on a stream and, with the same result, on a table."""
    v = F.col(column_value).cast("double")
    rows = stream.withWatermark(column_time, watermark) if stream.isStreaming else stream
    grouped = rows.groupBy(F.window(column_time, window, slide), F.col(column_id).alias("id"), F.col(column_kind).alias("kind"))
    out = grouped.agg(*[ALGEBRAIC[f](v).alias(f) for f in features])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "id", "kind", *features)
