"""Splitting hot keys: contiguous chunks with halos, and joins that salt hot keys only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.util import checkpointed, private_names, shuffle_partitions

#: A key is hot if it holds at least this share of all rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
SALTS = 16


def halo_chunks(df: DataFrame, key: str, order: Sequence[str], halo: int, chunk: str = "chunk", core: str = "is_core", partitions: int | None = None) -> DataFrame:
    """Cut every key's rows into contiguous chunks, each with up to ``halo`` rows of its neighbours on either side.

    ``order`` must be unique within a key. A window over (key, chunk) in that order then sees, for each row with ``core`` true, the same
    ``halo`` rows before and after as a window over the whole key would. Rows are cut by range, so a key with a
    third of all rows is spread over a third of the partitions. Each row is core in exactly one chunk.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    ring = Window.partitionBy(key).orderBy(chunk)
    while True:
        # Checkpointed, as the chunk numbers must not change when a lost task is run again.
        cut = checkpointed(df.repartitionByRange(n, key, *order).withColumn(chunk, F.spark_partition_id()))
        of_key = cut.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("_rows"))
        of_key = of_key.select(key, chunk, "_rows", F.lead(chunk).over(ring).alias("_next"), F.lag(chunk).over(ring).alias("_prev"))
        # A chunk between two others of its key must fill their halos; where tables are small, fewer ranges are cut.
        if n == 1 or of_key.where((F.col("_rows") < halo) & F.col("_next").isNotNull() & F.col("_prev").isNotNull()).isEmpty():
            break
        n = max(1, n // 4)
    of_key = of_key.drop("_rows")
    fwd = Window.partitionBy(key, chunk).orderBy(*[F.col(c) for c in order])
    back = Window.partitionBy(key, chunk).orderBy(*[F.col(c).desc() for c in order])
    # Only chunks with a neighbour of the same key need halos.
    torn = of_key.where("_next is not null or _prev is not null")
    # At most two torn (key, chunk) pairs per cut: bounded by the number of partitions.
    edge = cut.join(F.broadcast(torn), [key, chunk])
    edge = edge.withColumn("_a", F.row_number().over(fwd)).withColumn("_z", F.row_number().over(back))
    keep = [c for c in df.columns]
    after = edge.where((F.col("_z") <= halo) & F.col("_next").isNotNull()).select(*keep, F.col("_next").alias(chunk), F.lit(False).alias(core))
    before = edge.where((F.col("_a") <= halo) & F.col("_prev").isNotNull()).select(*keep, F.col("_prev").alias(chunk), F.lit(False).alias(core))
    return cut.select(*keep, chunk, F.lit(True).alias(core)).unionByName(after).unionByName(before)


def salted_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], count: str, spread_by: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of ``rows`` to one row per key (whose column ``count`` has the key's number of rows), splitting hot keys.

    The rows of a hot key are dealt to ``SALTS`` groups by a hash of ``spread_by``, and the key's one row is copied to each. The list of hot
    keys has at most 1 / HOT_SHARE entries, which is why it may be broadcast.
    """
    name = private_names(*rows.columns, *per_key.columns)
    salt, hot = name("salt"), name("hot")
    total = per_key.agg(F.sum(count).alias("t")).scalar()
    is_hot = F.col(count) >= F.lit(HOT_SHARE) * total
    hot_keys = per_key.where(is_hot).select(*keys, F.lit(True).alias(hot))
    dealt = rows.join(F.broadcast(hot_keys), list(keys), "left").withColumn(
        salt, F.when(F.col(hot), F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    copies = per_key.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop(hot).join(copies, [*keys, salt], how).drop(salt)
