"""Irregular readings onto a regular grid, by compact-kernel weighted local linear regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.util import micros, usable

#: Slots that one row of the grid's skeleton carries; the skeleton of a long source is cut into pieces of this many.
SLOTS_PER_PIECE = 4096


def regular_grid(
    readings: DataFrame,
    sources: DataFrame,
    source: str = "id",
    time: str = "time",
    value: str = "value",
    step: str = "step_s",
    reading: str | None = "reading_id",
    bandwidth_slots: int = 2,
    least_support: float = 1.5,
) -> DataFrame:
    """One row per source and slot from its first to its last slot with a usable reading.

    A slot starts at a multiple of the source's step (whole seconds since 1970-01-01 UTC). Readings with NULL source or time, or whose
    value is NULL or NaN, are not usable; equal ``reading`` ids count once (``reading=None``: every row counts), and of readings without an id those that
    agree in source, time and value. Infinite values
    occupy their slot but carry no weight. Sources with a NULL or non-positive step, or not listed, have no grid.

    Each slot's estimate is a local linear regression at the slot's centre over the readings less than ``bandwidth_slots``
    + 1/2 steps away, with Epanechnikov weights. It needs no sort and no gathering: a reading knows from its slot number
    which slots it can reach (at most 2 * bandwidth_slots + 1), sends its kernel moments there, and moments add up.
    ``support`` is the effective number of readings, (sum w)^2 / sum w^2. Where the support is under ``least_support`` or all
    weight lies at one time, the fit is the weighted mean instead of the line if the slot itself holds a reading; a slot
    without readings and with support under ``least_support`` is left NULL and marked.

    Result: source, slot_epoch, value, n_readings, support, status: ``observed`` (holds a reading), ``filled`` (none, estimated
    from neighbours), ``missing`` (none, too little support).
    """
    steps = sources.where(F.col(step) > 0).groupBy(F.col(source).alias("_s")).agg(F.min(step).cast("long").alias("_step"))
    good = readings.where(F.col(source).isNotNull() & F.col(time).isNotNull() & usable(F.col(value).cast("double")))
    cols = [F.col(source).alias("_s"), micros(F.col(time)).alias("_t"), F.col(value).cast("double").alias("_v")]
    if reading is None:
        rows = good.select(*cols)
    else:
        nameless = [F.when(F.col(reading).isNull(), F.col(c)).alias(f"_n{i}") for i, c in enumerate((source, time, value))]
        rows = good.groupBy(F.col(reading).alias("_r"), *nameless).agg(F.min(F.struct(*cols)).alias("x")).select("x.*")
    at = rows.join(steps, "_s").withColumn("_k", F.floor(F.col("_t") / (F.col("_step") * 1_000_000)))
    reach = bandwidth_slots
    sent = at.withColumn("_to", F.explode(F.sequence(F.col("_k") - reach, F.col("_k") + reach)))
    # Distance to the slot's centre in steps; the kernel's half width is reach + 1/2 steps.
    x = (F.col("_t") - (F.col("_to") + 0.5) * F.col("_step") * 1_000_000) / (F.col("_step") * 1_000_000)
    u = x / (reach + 0.5)
    finite = F.abs(F.col("_v")) != F.lit(float("inf"))
    w = F.when(finite & (F.abs(u) < 1), 0.75 * (1 - u * u)).otherwise(F.lit(0.0))
    sent = sent.select("_s", "_step", "_to", (F.col("_to") == F.col("_k")).cast("int").alias("own"), w.alias("w"), x.alias("x"), F.when(finite, F.col("_v")).otherwise(0.0).alias("v"))
    wx = F.col("w") * F.col("x")
    moments = sent.groupBy("_s", "_to").agg(
        F.sum("own").alias("n_readings"),
        F.sum("w").alias("s0"),
        F.sum(wx).alias("s1"),
        F.sum(wx * F.col("x")).alias("s2"),
        F.sum(F.col("w") * F.col("v")).alias("t0"),
        F.sum(wx * F.col("v")).alias("t1"),
        F.sum(F.col("w") * F.col("w")).alias("ww"),
    )
    ends = at.groupBy("_s", "_step").agg(F.min("_k").alias("a"), F.max("_k").alias("b"))
    piece = F.lit(SLOTS_PER_PIECE)
    pieces = ends.withColumn("p", F.explode(F.sequence(F.floor(F.col("a") / piece), F.floor(F.col("b") / piece))))
    slots = pieces.select("_s", "_step", F.explode(F.sequence(F.greatest("a", F.col("p") * piece), F.least("b", F.col("p") * piece + (piece - 1)))).alias("_to"))
    grid = slots.join(moments, ["_s", "_to"], "left")
    support = F.coalesce(F.try_divide(F.col("s0") * F.col("s0"), F.col("ww")), F.lit(0.0))
    n = F.coalesce(F.col("n_readings"), F.lit(0))
    mean = F.try_divide(F.col("t0"), F.col("s0"))
    spread = F.try_divide(F.col("s2"), F.col("s0")) - F.pow(F.try_divide(F.col("s1"), F.col("s0")), 2)
    line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
    enough = F.col("support") >= least_support
    return (
        grid.withColumn("support", support)
        .select(
            F.col("_s").alias(source),
            (F.col("_to") * F.col("_step")).alias("slot_epoch"),
            F.when(enough & (spread > 1e-3), line).when(enough | (n > 0), mean).alias("value"),
            n.cast("long").alias("n_readings"),
            "support",
            F.when(n > 0, "observed").when(enough, "filled").otherwise("missing").alias("status"),
        )
    )
