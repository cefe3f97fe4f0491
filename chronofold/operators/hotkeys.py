"""Per-key results where a few keys hold most of the rows.

Two forms:

* ``keyed_aggregate``: results that are algebraic in the rows (counts, sums, means, extremes, first and last by an
  order). The native partial aggregate keeps one bounded, spilling hash table of mergeable states per map task; only one
  state per (task, key) is shuffled, so the size of a key does not matter.
* ``ordered_profile``: results that depend on the order of a key's rows. Rows are range-partitioned on (keys, order),
  which cuts a hot key into as many contiguous chunks as it needs; each chunk yields one compact state (ends, sums, sum
  of changes), and the states of a key are merged in order, adding the change across each cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.util import checkpointed, private_names, shuffle_partitions, usable


def keyed_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """One row per key with algebraic aggregates.

    NULL is a key of its own. An empty table gives an empty result. ``aggregates`` may name any native algebraic
    aggregate; distinct and collecting aggregates do not belong here, as their states are not bounded.
    """
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys (without a NULL part) that hold at least ``share`` of all rows of ``df``, with their counts.

    All rows count towards the total, those with a NULL key too. Empty table: no rows.
    """
    # A row per key: written once, so that the table is read once for the counts and their total.
    counts = checkpointed(keyed_aggregate(df, keys, {"n_rows": F.count(F.lit(1))}))
    total = counts.agg(F.sum("n_rows").alias("total"))
    kept = counts.where(F.col("n_rows") >= F.lit(share) * total.scalar())
    return kept.where(" and ".join(f"`{k}` is not null" for k in keys))


def ordered_profile(df: DataFrame, keys: Sequence[str], order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Length, mean, extremes and order-dependent features of each key without a NULL part.

    Rows with equal (keys, order) are repeats of one row: they count once, with the smallest of their usable values.
    NULL and NaN are no values: such rows count in ``n_rows`` only. A key without values has NULL in all
    other columns but ``n_values`` (0). Rows with a NULL order form one row, before all others. Other columns are
    ignored.

    Result: keys, n_rows, n_values, mean, std (population), minimum, maximum, first_value, last_value, mean_change,
    absolute_sum_of_changes, number_crossing_zero.
    """
    name = private_names(*keys)
    v, o, part = name("v"), name("o"), name("chunk")
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(
        *keys, F.col(order).alias(o), F.when(usable(F.col(value).cast("double")), F.col(value).cast("double")).alias(v)
    )
    n = partitions or shuffle_partitions(df.sparkSession)
    # Equal (keys, order) meet in one range, so the repeats of a row never straddle a cut.
    cut = rows.repartitionByRange(n, *keys, o).withColumn(part, F.spark_partition_id())
    once = cut.groupBy(part, *keys, o).agg(F.min(v).alias(v))
    here = Window.partitionBy(part, *keys).orderBy(F.asc_nulls_first(o))
    prev = name("prev")
    steps = once.withColumn(prev, F.last(v, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    states = steps.groupBy(part, *keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_values"),
        F.avg(v).alias("m"),
        F.sum(v).alias("s"),
        F.var_pop(v).alias("q"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.expr(f"min_by(`{v}`, struct(`{o}`)) filter (where `{v}` is not null)").alias("head"),
        F.expr(f"max_by(`{v}`, struct(`{o}`)) filter (where `{v}` is not null)").alias("tail"),
        F.sum(F.abs(F.col(v) - F.col(prev))).alias("moves"),
        F.sum(((F.col(v) > 0) != (F.col(prev) > 0)).cast("long")).alias("crossings"),
    )
    chunks = Window.partitionBy(*keys).orderBy(part)
    tail = F.last("tail", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys)
    center = F.try_divide(F.sum("s").over(whole), F.sum("n_values").over(whole))
    joined = states.withColumn("before", tail).withColumn("mu", center)
    total = F.sum("n_values")
    mean = F.try_divide(F.sum("s"), total)
    merged = joined.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        total.alias("n_values"),
        mean.alias("mean"),
        # Var = mean of the chunks' variances + variance of their means, weighted by their lengths.
        F.sqrt(F.try_divide(F.sum(F.col("n_values") * (F.col("q") + F.pow(F.col("m") - F.col("mu"), 2))), total)).alias("std"),
        F.min("lo").alias("minimum"),
        F.max("hi").alias("maximum"),
        F.expr(f"min_by(head, `{part}`) filter (where head is not null)").alias("first_value"),
        F.expr(f"max_by(tail, `{part}`) filter (where tail is not null)").alias("last_value"),
        (F.coalesce(F.sum("moves"), F.lit(0.0)) + F.coalesce(F.sum(F.abs(F.col("head") - F.col("before"))), F.lit(0.0))).alias("moves"),
        (F.coalesce(F.sum("crossings"), F.lit(0)) + F.coalesce(F.sum(((F.col("head") > 0) != (F.col("before") > 0)).cast("long")), F.lit(0))).alias("crossings"),
    )
    some = F.col("n_values") > 0
    return merged.select(
        *keys,
        "n_rows",
        "n_values",
        "mean",
        "std",
        "minimum",
        "maximum",
        "first_value",
        "last_value",
        F.when(F.col("n_values") > 1, (F.col("last_value") - F.col("first_value")) / (F.col("n_values") - 1)).alias("mean_change"),
        F.when(some, F.col("moves")).alias("absolute_sum_of_changes"),
        F.when(some, F.col("crossings")).alias("number_crossing_zero"),
    )
