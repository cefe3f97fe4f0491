"""Queries of the document operators. They are tested against brute force; what SQL can say is what they promise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import mixing, mojibake, packing, tokens
from chronofold.util import checkpointed, table


def _sizes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    # Checkpointed: the sizes are used several times, and tokenizing is the dear part.
    return checkpointed(tokens.token_sizes(table(spark, d, "documents"), list(keep)))


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["container"]: r["capacity_tokens"] for r in table(spark, d, "capacities").collect()}


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d, "doc_id"), _capacities(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d), _capacities(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "doc_id", "source"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "doc_id", "source"), table(spark, d, "mix_targets"))[1]


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What packing promises, per container: no bin over its capacity, no text cut that fits one, every text placed once and whole."""
    capacities = _capacities(spark, d)
    sizes = _sizes(spark, d, "doc_id")
    packed = packing.pack(sizes, capacities)
    cap = F.create_map(*[F.lit(x) for c, n in capacities.items() for x in (c, n)])[F.col("container")]
    bins = packed.where("bin_id is not null").groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("t")).groupBy("container").agg(F.count_if(F.col("t") > cap).alias("bins_over_capacity"))
    texts = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("t")).join(sizes.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id")
    texts = texts.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("whole") <= cap)).alias("cut_though_they_fit"), F.count_if(F.col("t") != F.col("whole")).alias("not_whole"))
    return texts.join(bins, "container").select("container", "texts", "bins_over_capacity", "cut_though_they_fit", "not_whole")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What mixing promises, per source with a target: no text used too often, no part of a text twice in a pass, and no share missed that the source could give."""
    sizes = _sizes(spark, d, "doc_id", "source")
    mixed, report = mixing.mix(sizes, table(spark, d, "mix_targets"))
    once = mixed.groupBy("source", "doc_id", "first_token", "pass").agg(F.count(F.lit(1)).alias("n"))
    uses = once.groupBy("source", "doc_id", "first_token").agg(F.sum("n").alias("n"), F.max("n").alias("in_a_pass")).groupBy("source").agg(F.max("n").alias("most"), F.max("in_a_pass").alias("in_a_pass"))
    open_ = (F.col("drawn_tokens") < F.col("available_tokens") * F.col("max_repeats") - mixing.BLOCK) & (F.col("reached_share") < F.col("target_share") - 0.02)
    got = report.where("target_share > 0").join(uses, "source", "left")
    return got.select("source", F.coalesce(F.col("most") > F.col("max_repeats"), F.lit(False)).alias("used_too_often"), F.coalesce(F.col("in_a_pass") > 1, F.lit(False)).alias("twice_in_a_pass"), open_.alias("share_missed"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents")).where("garbled").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents")).where("garbled")


QUERIES = {"p7_packed": p7_packed, "p7_report": p7_report, "p7_invariants": p7_invariants, "p8_mix": p8_mix, "p8_report": p8_report, "p8_invariants": p8_invariants, "p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict[str, str] = {
    "p7_invariants": "SELECT container, (SELECT count(*) FROM documents) AS texts, CAST(0 AS BIGINT) AS bins_over_capacity, CAST(0 AS BIGINT) AS cut_though_they_fit, CAST(0 AS BIGINT) AS not_whole FROM capacities",
    "p8_invariants": "SELECT source, false AS used_too_often, false AS twice_in_a_pass, false AS share_missed FROM mix_targets WHERE target_share > 0",
}
