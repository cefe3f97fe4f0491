"""Small helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session may leave it unset (tests); then a
    temporary folder is used. On a cluster that is an error: executors would write to their own disks.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"chronofold-{uuid.uuid4().hex}"))
    return df.checkpoint(eager=True)


def spread_out(df: DataFrame) -> DataFrame:
    """A frame whose rows cost far more than moving them, spread over all cores if it has fewer partitions than that.

    Large inputs have more partitions than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def usable(value: Column) -> Column:
    """True where a double is a value: neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 UTC, whatever the session's time zone."""
    return F.unix_micros(ts)


def utc_day(ts: Column) -> Column:
    """Days since 1970-01-01 UTC, whatever the session's time zone."""
    return F.floor(F.unix_micros(ts) / F.lit(MICROS_PER_DAY)).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def private_names(*taken: str) -> "function":
    """A function that yields column names which collide with none of the given ones."""
    used = {t.lower() for t in taken}

    def name(wish: str) -> str:
        got = wish
        while got.lower() in used:
            got = "_" + got
        used.add(got.lower())
        return got

    return name


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on all executors of a session that was started without it on its Python path.

    The archive is served by the driver to each executor, as any file added to a session.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "chronofold_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
