"""Readers and writers of series in text files, and a simulator of labelled series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _strip(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """Each line of numbers is one series: (id, time, value), ids by line in file order, times from 0."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(_strip("value") != "")
    parts = F.posexplode(F.split(_strip("value"), r"\s+"))
    return lines.select(F.col("line").alias("id"), parts.alias("time", "text")).select("id", F.col("time").cast("long").alias("time"), F.col("text").try_cast("double").alias("value"))


def read_with_header(spark: SparkSession, path: str, id_columns: tuple[str, ...] = ("id",)) -> DataFrame:
    """White-space separated columns under one header line; numbers, but for the ``id_columns``."""
    lines = spark.read.text(path).where(_strip("value") != "")
    header = lines.first()["value"]
    names = header.split()
    parts = F.split(_strip("value"), r"\s+")
    cols = [parts[i].alias(n) if n in id_columns else parts[i].try_cast("double").alias(n) for i, n in enumerate(names)]
    return lines.where(F.col("value") != header).select(*cols)


def read_wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers, one series of fixed length per line: (id, values)."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).where(_strip("value") != "")
    return lines.select("id", F.transform(F.split(_strip("value"), r"\s+"), lambda t: t.try_cast("double")).alias("values"))


def read_blocks(spark: SparkSession, path: str, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Text blocks: a line with a label, then tab-separated lines of readings, then a blank line. (series: id, time, names...; labels: id, label).

    A block is read as one record, so files are split between blocks only.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("block", _strip("value")).where("block <> ''")
    blocks = blocks.select(F.monotonically_increasing_id().alias("id"), F.split("block", "\n").alias("lines"))
    labels = blocks.select("id", _strip(F.element_at("lines", 1)).alias("label"))
    rows = blocks.select("id", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("time", "line"))
    parts = F.split(_strip("line"), r"\s+")
    return rows.select("id", F.col("time").cast("long").alias("time"), *[parts[i].try_cast("double").alias(n) for i, n in enumerate(names)]), labels


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").option("header", True).csv(path)


def simulate_drift(spark: SparkSession, n: int = 100, length: int = 10, classification: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two-dimensional trajectories near a bifurcation: (series: id, time, dimension, value; target: id, y).

    Velocities follow the Langevin equation dv = (a v - b |v|^2 v) dt + noise; the target is the sign of the drift's parameter, or the parameter.
    """
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        tau = float(rng.choice([-1.0, 1.0]) if classification else rng.uniform(-1, 1))
        v, dt = rng.normal(0, 0.5, 2), 0.05
        for k in range(length):
            rows += [(i, k * dt, d, float(v[d])) for d in range(2)]
            v = v + (tau * v - (v @ v) * v) * dt + rng.normal(0, 0.05, 2) * dt**0.5
        labels.append((i, int(tau < 0)) if classification else (i, tau))
    series = spark.createDataFrame(rows, "id long, time double, dimension long, value double")
    return series, spark.createDataFrame(labels, "id long, y " + ("long" if classification else "double"))
