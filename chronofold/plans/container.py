"""One form for all inputs: the canonical long frame (_id, _kind, _s, _v [, _ts])."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Container = DataFrame | pd.DataFrame | Mapping[str, DataFrame]


def q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def check_kind(name: str) -> None:
    if "__" in name or name.endswith("_"):
        raise ValueError(f"a kind must not contain two underscores or end in one: {name!r}")


def check_columns(df: DataFrame, *columns: str | None) -> None:
    for c in columns:
        if c is not None and c not in df.columns:
            raise ValueError(f"no column {c!r}")


def check_nulls(df: DataFrame, columns: list[str]) -> None:
    """One pass over the data: no column may hold NULL or NaN."""
    types = dict(df.dtypes)
    bad = [F.count_if(q(c).isNull() | (F.isnan(q(c)) if types[c] in ("double", "float") else F.lit(False))).alias(f"c{i}") for i, c in enumerate(columns)]
    found = df.agg(*bad).collect()[0]
    if wrong := [c for i, c in enumerate(columns) if found[f"c{i}"]]:
        raise ValueError(f"columns with missing values: {wrong}")


def as_frame(given: object) -> DataFrame:
    """A Spark frame; a pandas frame is sent to the running session."""
    if isinstance(given, pd.DataFrame):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise ValueError("a pandas frame needs a running session")
        return spark.createDataFrame(given)
    if not isinstance(given, DataFrame):
        raise ValueError("a frame or a mapping of frames is needed")
    return given


def kinds_of(container: Container, column_id: str, column_sort: str | list[str] | None, column_kind: str | None, column_value: str | None, column_time: str | None) -> list[str] | None:
    """The kinds, where the form of the input names them; None where they are data."""
    if isinstance(container, Mapping):
        return [str(k) for k in container]
    if column_kind is not None:
        return None
    if column_value:
        return [column_value]
    sorts = [] if column_sort is None else [column_sort] if isinstance(column_sort, str) else list(column_sort)
    return [c for c in container.columns if c not in (column_id, *sorts, column_time)]


def to_long(
    container: Container,
    column_id: str,
    column_sort: str | list[str] | None = None,
    column_kind: str | None = None,
    column_value: str | None = None,
    column_time: str | None = None,
    validate: bool = True,
) -> DataFrame:
    """Long frames (``column_kind``), wide frames (every other column a kind) and {kind: frame} as (_id, _kind, _s, _v [, _ts]).

    ``column_sort`` may be a list, for a unique order. Without it the rows have no order of their own; then an order of the values' own is used, so
    that results do not depend on the partitioning. With ``validate`` missing values are errors (one pass over the data).
    """
    sorts = [] if column_sort is None else [column_sort] if isinstance(column_sort, str) else list(column_sort)
    if isinstance(container, Mapping):
        if column_kind is not None:
            raise ValueError("a mapping of frames has its kinds as keys, not in a column")
        parts = []
        for kind, df in container.items():
            check_kind(str(kind))
            parts.append(_long(as_frame(df), column_id, sorts, F.lit(str(kind)), column_value, column_time, validate))
        if not parts:
            raise ValueError("no frames")
        return reduce(DataFrame.unionByName, parts)
    container = as_frame(container)
    check_columns(container, column_id, *sorts, column_kind, column_value, column_time)
    if column_kind is not None:
        return _long(container, column_id, sorts, q(column_kind).cast("string"), column_value, column_time, validate, (column_kind,))
    taken = [column_id, *sorts, *([column_time] if column_time else [])]
    values = [column_value] if column_value else [c for c in container.columns if c not in taken]
    if not values:
        raise ValueError("no value columns")
    for c in values:
        check_kind(c)
    if validate:
        check_nulls(container, list(dict.fromkeys([*taken, *values])))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), q(c).cast("double").alias("v")) for c in values]))
    wide = container.select(q(column_id).alias("_id"), _sort(sorts), *([q(column_time).cast("timestamp").alias("_ts")] if column_time else []), pairs.alias("_p"))
    out = wide.select("_id", F.col("_p.k").alias("_kind"), "_s", F.col("_p.v").alias("_v"), *(["_ts"] if column_time else []))
    return out if sorts else out.withColumn("_s", F.struct("_v"))


def _sort(sorts: list[str]):
    return (F.struct(*[q(c).alias(f"s{i}") for i, c in enumerate(sorts)]) if sorts else F.lit(None)).alias("_s")


def _long(df: DataFrame, column_id: str, sorts: list[str], kind, column_value: str | None, column_time: str | None, validate: bool, kinds: tuple = ()) -> DataFrame:
    check_columns(df, column_id, *sorts, column_value, column_time)
    taken = [column_id, *sorts, *kinds, *([column_time] if column_time else [])]
    if column_value is None:
        free = [c for c in df.columns if c not in taken]
        if len(free) != 1:
            raise ValueError(f"the value column cannot be told: {free}")
        column_value = free[0]
    if validate:
        check_nulls(df, list(dict.fromkeys([*taken, column_value])))
    out = df.select(q(column_id).alias("_id"), kind.alias("_kind"), _sort(sorts), q(column_value).cast("double").alias("_v"), *([q(column_time).cast("timestamp").alias("_ts")] if column_time else []))
    return out if sorts else out.withColumn("_s", F.struct("_v"))
