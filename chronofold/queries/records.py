"""Queries of the record-cleaning operators on the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import hotkeys, lowrank, regrid, spikes, trailing, widen
from chronofold.queries.features import SHIFT
from chronofold.queries.records_sql import SQL  # noqa: F401
from chronofold.util import table

PAIR = ["id", "kind"]
MATRIX_TEXTS = ["regime", "y_label"]
MATRIX_NUMBERS = ["a__mean", "a__standard_deviation", "a__maximum", "b__median", "b__abs_energy", "b__mean_change"]
TWO = "decimal(18,2)"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, d, "series_long"), PAIR, 0.01).select(*PAIR)


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    got = hotkeys.ordered_profile(table(spark, d, "series_long"), PAIR, "sort", "value")
    return got.select(*PAIR, *[c if t == "bigint" else F.round(c, 4).alias(c) for c, t in got.dtypes if c not in PAIR])


def p2_trailing(spark: SparkSession, d: str) -> DataFrame:
    got = trailing.trailing_totals(table(spark, d, "df_melted"), "symbols", "date", "high", (7, 30), value_type=TWO)
    return got.select(
        "symbols", day_text("day").alias("day"), F.col("total_7").cast("double").alias("total_7"), F.round(F.col("average_7") + SHIFT, 4).alias("average_7"), F.col("total_30").cast("double").alias("total_30"), F.round(F.col("average_30") + SHIFT, 4).alias("average_30")
    )


def day_text(day: str):
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(day)), "yyyy-MM-dd")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = trailing.trailing_totals(table(spark, d, "df_melted"), "symbols", "date", "high", (7, 30), value_type=TWO)
    return got.where((F.col("day") >= F.col("first_day") + 29) & (F.col("total_7") * 2 > F.col("total_30"))).select("symbols", day_text("day").alias("day"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    wide = widen.widen(table(spark, d, "feature_rows"), table(spark, d, "feature_names"), flags=True)
    return widen.cell_issues(wide)


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return widen.widen(table(spark, d, "feature_rows"), table(spark, d, "feature_names"))


def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    return lowrank.fill_from_similar(table(spark, d, "feature_matrix"), "grp", "snap_time", MATRIX_NUMBERS, MATRIX_TEXTS, "loaded_at", ["id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    marks = p4_filled(spark, d).where("grp is not null").select("id", F.explode("filled").alias("variable", "scope"))
    return marks.where("scope = 'group'").select("id", "variable")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = spikes.flag_readings(table(spark, d, "sensor_readings"), table(spark, d, "sensors"))
    return got.where("flagged").select("reading_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = regrid.regular_grid(table(spark, d, "sensor_readings"), table(spark, d, "sensors"))
    return got.where("n_readings = 0").select("id", "slot_epoch")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    got = regrid.regular_grid(table(spark, d, "sensor_readings"), table(spark, d, "sensors"))
    return got.select(*[F.round(F.col(c) + SHIFT, 4).alias(c) if c in ("value", "support") else F.col(c) for c in got.columns])


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p2_found": p2_found, "p2_trailing": p2_trailing, "p3_found": p3_found, "p3_wide": p3_wide, "p4_found": p4_found, "p4_filled": p4_filled, "p5_found": p5_found, "p6_found": p6_found, "p6_grid": p6_grid}
