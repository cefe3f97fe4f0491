"""Rolling windows, forecasting frames and sub-series, as frames to extract features from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.util import private_names


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _numbered(df: DataFrame, keys: list[str], column_sort: str | None, rn: str, n: str) -> DataFrame:
    """Rows of each series numbered from 1 in order, with the series' length."""
    whole = Window.partitionBy(*[_q(k) for k in keys])
    order = _q(column_sort) if column_sort else F.monotonically_increasing_id()
    return df.withColumn(rn, F.row_number().over(whole.orderBy(order)).cast("long")).withColumn(n, F.count(F.lit(1)).over(whole))


def roll_time_series(
    df_or_dict: DataFrame | Mapping[str, DataFrame],
    column_id: str,
    column_sort: str | None = None,
    column_kind: str | None = None,
    rolling_direction: int = 1,
    max_timeshift: int | None = None,
    min_timeshift: int = 0,
) -> DataFrame | dict[str, DataFrame]:
    """Every window of every series as a series of its own, with ``id`` = struct(id, timeshift).

    A positive direction d moves the right end of the window: windows end at every d-th row counted back from the length of the longest series
    of the table, hold at most ``max_timeshift`` + 1 rows and at least ``min_timeshift`` + 1; the timeshift is the order value of the last row. A negative
    direction moves the left end, from the first row on; the timeshift is the order value of the first row. Without ``column_sort`` rows keep the order
    they have, which is also written to a column ``sort``, and the timeshift is the row's number in its series.

    Rows are multiplied by up to ``max_timeshift`` + 1 (quadratic in the length if it is not given): a row tells from its number which windows
    it is in and is copied there, without a join. For algebraic features see ``rolling_features``, which copies nothing.
    """
    if rolling_direction == 0:
        raise ValueError("a rolling direction of 0 does not move")
    if max_timeshift is not None and max_timeshift <= 0:
        raise ValueError("max_timeshift must be positive")
    if min_timeshift < 0:
        raise ValueError("min_timeshift must not be negative")
    if isinstance(df_or_dict, Mapping):
        if column_kind is not None:
            raise ValueError("a mapping of frames has its kinds as keys, not in a column")
        return {k: roll_time_series(v, column_id, column_sort, None, rolling_direction, max_timeshift, min_timeshift) for k, v in df_or_dict.items()}
    df = df_or_dict
    if column_id not in df.columns:
        raise AttributeError(f"no column {column_id!r}")
    if column_sort is not None and column_sort not in df.columns:
        raise ValueError(f"no column {column_sort!r}")
    keys = [column_id, *([column_kind] if column_kind else [])]
    name = private_names(*df.columns)
    rn, n, at, size = (name(x) for x in ("rn", "n", "window", "size"))
    step, most = abs(rolling_direction), max_timeshift
    checks = [F.count(F.lit(1)).alias("rows")] + ([F.count_if(_q(column_sort).isNull()).alias("bad")] if column_sort else [])
    longest = df.groupBy(*[_q(k) for k in keys]).agg(*checks)
    got = longest.agg(F.max("rows"), F.sum("rows"), *([F.sum("bad")] if column_sort else [])).collect()[0]
    if (got[1] or 0) <= 1:
        raise ValueError("a table of one row cannot be rolled")
    if column_sort and got[2]:
        raise ValueError("the sort column has missing values")
    longest_rows = got[0]
    if most is None:
        most = longest_rows
    rows = _numbered(df, keys, column_sort, rn, n)
    r, m = F.col(rn), F.col(n)
    if rolling_direction > 0:
        # The ends of the windows that row r is in and that lie on the grid counted back from the longest series.
        first = r + F.pmod(F.lit(longest_rows) - r, F.lit(step))
        ends = F.when(first <= F.least(r + most, m), F.sequence(first, F.least(r + most, m), F.lit(step).cast("long")))
        rows = rows.withColumn(at, F.explode(ends))
        rows = rows.where(F.least(F.col(at), F.lit(most + 1)) >= min_timeshift + 1)
    else:
        start = F.greatest(F.lit(1).cast("long"), r - most)
        first = start + F.pmod(1 - start, F.lit(step))
        rows = rows.withColumn(at, F.explode(F.when(first <= r, F.sequence(first, r, F.lit(step).cast("long")))))
        rows = rows.where(F.least(F.lit(most + 1), m - F.col(at) + 1) >= min_timeshift + 1)
    if column_sort:
        # The order value of the window's defining row: the one numbered ``at``.
        w = Window.partitionBy(*[_q(k) for k in keys], at)
        shift = F.max(F.when(r == F.col(at), _q(column_sort))).over(w)
        kept = df.columns
    else:
        shift = F.col(at) - 1
        rows = rows.withColumn("sort", r - 1)
        kept = [*df.columns, *([] if "sort" in df.columns else ["sort"])]
    del size
    rows = rows.withColumn(at, F.struct(_q(column_id).alias("id"), shift.alias("timeshift")))
    return rows.select(F.col(at).alias("id"), *[_q(c) for c in kept if c != "id"])


#: Features that a moving frame gives without copying rows.
MOVING = {
    "sum_values": lambda v, w: F.sum(v).over(w),
    "mean": lambda v, w: F.avg(v).over(w),
    "length": lambda v, w: F.count(v).over(w).cast("double"),
    "standard_deviation": lambda v, w: F.stddev_pop(v).over(w),
    "variance": lambda v, w: F.var_pop(v).over(w),
    "root_mean_square": lambda v, w: F.sqrt(F.avg(v * v).over(w)),
    "maximum": lambda v, w: F.max(v).over(w),
    "minimum": lambda v, w: F.min(v).over(w),
    "absolute_maximum": lambda v, w: F.max(F.abs(v)).over(w),
    "abs_energy": lambda v, w: F.sum(v * v).over(w),
    "median": lambda v, w: F.median(v).over(w),
}


def rolling_features(df: DataFrame, column_id: str, column_sort: str, column_kind: str | None, column_value: str, max_timeshift: int, min_timeshift: int = 0, features: tuple[str, ...] = tuple(MOVING)) -> DataFrame:
    """Features of all windows that end at each row (positive direction, step 1): (id, timeshift, kind, features...), from one sort and moving frames."""
    if unknown := set(features) - set(MOVING):
        raise ValueError(f"not features of a moving frame: {sorted(unknown)}")
    keys = [_q(column_id), *([_q(column_kind)] if column_kind else [])]
    w = Window.partitionBy(*keys).orderBy(_q(column_sort))
    frame = w.rowsBetween(-max_timeshift, 0)
    v = _q(column_value).cast("double")
    kind = _q(column_kind) if column_kind else F.lit(column_value)
    rows = df.select(_q(column_id).alias("id"), _q(column_sort).alias("timeshift"), kind.alias("kind"), F.row_number().over(w).alias("_rn"), *[MOVING[f](v, frame).alias(f) for f in features])
    return rows.where(F.least(F.col("_rn"), F.lit(max_timeshift + 1)) >= min_timeshift + 1).drop("_rn")


def make_forecasting_frame(x: DataFrame, kind: str, max_timeshift: int | None, rolling_direction: int = 1, min_timeshift: int = 0, column_sort: str = "time", column_value: str = "value") -> tuple[DataFrame, DataFrame]:
    """One series (order, value) as windows without their last row, and the value to forecast for each: (frame, target).

    The frame has id = struct("id", timeshift), time, value, kind; the target has id and y, the value at the window's timeshift. The first value is
    never a target, nor is one whose window holds nothing but itself.
    """
    base = x.select(F.lit("id").alias("id"), _q(column_sort).alias("time"), _q(column_value).cast("double").alias("value"), F.lit(kind).alias("kind"))
    rolled = roll_time_series(base, "id", "time", "kind", rolling_direction, max_timeshift, min_timeshift)
    last = Window.partitionBy("id").orderBy(F.desc("time"))
    frame = rolled.withColumn("_back", F.row_number().over(last)).where("_back > 1").drop("_back")
    firsts = base.agg(F.min("time").alias("first"))
    target = base.join(F.broadcast(firsts), F.col("time") > F.col("first")).select(F.struct(F.col("id"), F.col("time").alias("timeshift")).alias("id"), F.col("value").alias("y"))
    return frame, target.join(frame.select("id").distinct(), "id", "left_semi")


def add_sub_time_series_index(df_or_dict: DataFrame | Mapping[str, DataFrame], sub_length: int, column_id: str | None = None, column_sort: str | None = None, column_kind: str | None = None) -> DataFrame | dict[str, DataFrame]:
    """Cut every series into pieces of ``sub_length`` rows; the last may be shorter. ``id`` = struct(chunk, id), or the chunk's number without ``column_id``."""
    if sub_length <= 0:
        raise ValueError("sub_length must be positive")
    if isinstance(df_or_dict, Mapping):
        return {k: add_sub_time_series_index(v, sub_length, column_id, column_sort, column_kind) for k, v in df_or_dict.items()}
    df = df_or_dict
    keys = [k for k in (column_id, column_kind) if k]
    order = _q(column_sort) if column_sort else F.monotonically_increasing_id()
    number = F.row_number().over(Window.partitionBy(*[_q(k) for k in keys]).orderBy(order)) - 1
    chunk = F.floor(number / sub_length)
    new = F.struct(chunk.alias("chunk"), _q(column_id).alias("id")) if column_id else chunk
    return df.withColumn("_new", new).select(F.col("_new").alias("id"), *[_q(c) for c in df.columns if c != "id"])
