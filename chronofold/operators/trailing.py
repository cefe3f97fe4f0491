"""Totals and averages over trailing periods, for every calendar day of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.util import private_names, usable, utc_day


def trailing_totals(
    df: DataFrame,
    entity: str,
    date: str,
    value: str,
    periods: Sequence[int] = (7, 30),
    bucket_days: int | None = None,
    value_type: str = "double",
) -> DataFrame:
    """Totals, averages and row counts of ``value`` over the trailing ``periods`` (days, the day itself included).

    The calendar of an entity holds every UTC day from its first to its last row. Rows with a NULL entity, date or
    value, with NaN, or with a value ``value_type`` cannot hold do not exist; rows with equal (entity, date, value) count
    once; any other columns are ignored. A period without rows has total 0, count 0 and average NULL. Empty table: no
    rows. ``value_type`` may be a decimal type, which makes the totals exact.

    The rows are first reduced to one total per (entity, day): what a hot entity can hold after that is bounded by
    its calendar. Days of the calendar are then range-joined to the daily totals: both sides carry a coarse bucket of
    ``bucket_days`` days (default: the longest period), each calendar day looks into the two buckets its longest period
    can touch, and the exact bounds decide. The join is an equi-join on (entity, bucket).

    Result: entity, day (days since 1970-01-01), and for each period p: total_p, average_p, rows_p; first_day.
    """
    name = private_names(entity)
    day, total, rows, bucket, first, last, seen = (name(x) for x in ("day", "day_total", "day_rows", "bucket", "first_day", "last_day", "seen_day"))
    longest = max(periods)
    width = bucket_days or longest
    raw = F.col(value)
    typed = raw if value_type == "double" else raw.try_cast(value_type)
    kept = (
        df.where(F.col(entity).isNotNull() & F.col(date).isNotNull() & usable(raw.cast("double")))
        .select(entity, F.col(date).alias(day), typed.alias(total))
        .where(F.col(total).isNotNull())
        .distinct()
    )
    daily = kept.groupBy(entity, utc_day(F.col(day)).alias(seen)).agg(F.sum(total).alias(total), F.count(F.lit(1)).alias(rows))
    bounds = daily.groupBy(entity).agg(F.min(seen).alias(first), F.max(seen).alias(last))
    calendar = bounds.select(entity, first, F.explode(F.sequence(first, last)).alias(day))
    ask = calendar.withColumn(bucket, F.floor(F.col(day) / width))
    # A day's longest period reaches back at most ceil((longest - 1) / width) buckets.
    reach = -(-(longest - 1) // width)
    ask = ask.withColumn(bucket, F.explode(F.sequence(F.col(bucket) - reach, F.col(bucket))))
    have = daily.withColumn(bucket, F.floor(F.col(seen) / width))
    near = ask.join(have, [entity, bucket], "left")
    age = F.col(day) - F.col(seen)
    sums = []
    for p in periods:
        within = (age >= 0) & (age < p)
        sums += [F.sum(F.when(within, F.col(total))).alias(f"total_{p}"), F.sum(F.when(within, F.col(rows))).alias(f"rows_{p}")]
    found = near.groupBy(entity, day, first).agg(*sums)
    out = [F.col(entity), F.col(day).alias("day"), F.col(first).alias("first_day")]
    for p in periods:
        t, n = F.col(f"total_{p}"), F.coalesce(F.col(f"rows_{p}"), F.lit(0))
        out += [F.coalesce(t, F.lit(0)).alias(f"total_{p}"), F.try_divide(t.cast("double"), n).alias(f"average_{p}"), n.alias(f"rows_{p}")]
    return found.select(*out)
