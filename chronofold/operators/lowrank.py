"""Filling missing cells from similar records, by low-rank alternating least squares over mixed encoded cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.spread import salted_join
from chronofold.util import checkpointed, micros

#: What loaders write for "no value". Text is compared trimmed and in lower case.
NUMBER_STAND_INS = (-9999.0, -999.0, -99999.0, -999999.0, 1e30, -1e30, 1e20, -1e20, 9.969209968386869e36, 3.4028234663852886e38, -3.4028234663852886e38, 1.7976931348623157e308, -1.7976931348623157e308)
TEXT_STAND_INS = ("", "-", "--", "---", "?", "??", ".", "n/a", "#n/a", "na", "n.a.", "nan", "null", "(null)", "nil", "none", "unknown", "missing", "undefined", "unspecified", "not available", "tbd")

#: Rank, passes, ridge (as a multiple of what noise explains: 1 cuts it off), and how many records' worth of weight a wider mean has against a group's own.
RANK, PASSES, RIDGE, SHRINK = 3, 8, 0.8, 0.5
#: Every category of a text column becomes a column of cells; a text column with more distinct values than this is filled by modes instead.
MOST_CATEGORIES = 256


def present_number(c: Column) -> Column:
    """The value, or NULL for NULL, NaN, infinities and stand-ins. Zero is a value."""
    v = c.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))) & ~v.isin(*NUMBER_STAND_INS), v)


def present_text(c: Column) -> Column:
    """The value, or NULL for NULL, blanks and stand-ins."""
    return F.when(c.isNotNull() & ~F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")).isin(*TEXT_STAND_INS), c)


def _solve(v: np.ndarray, x: np.ndarray, m: np.ndarray, ridge: float) -> np.ndarray:
    """The least-squares factor of every record (row) given the feature factors ``v``, over observed cells only."""
    k = v.shape[1]
    outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), k * k)
    a = (m @ outer).reshape(-1, k, k) + ridge * np.eye(k)
    return np.linalg.solve(a, ((x * m) @ v)[:, :, None])[:, :, 0]


def _cells(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("cells").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
    m = ~np.isnan(x)
    return np.where(m, x, 0.0), m.astype(float)


def fit_factors(cells: DataFrame, p: int, rank: int, passes: int, ridge: float, seed: int = 1) -> np.ndarray:
    """Feature factors (p x rank) by alternating least squares over all records.

    A record's factor depends on its own cells and the feature factors only, so a pass solves it where the record lies and adds
    it to the normal equations of the features: p * (rank * (rank + 1) + 1) sums per task, whatever the number of records.
    """
    k = rank
    v = np.random.default_rng(seed).normal(0, 0.5, (p, k))
    for _ in range(passes):

        def sums(batches: Iterator[pa.RecordBatch], v: np.ndarray = v) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p * k * (k + 1) + p)
            for b in batches:
                x, m = _cells(b, p)
                u = _solve(v, x, m, ridge)
                outer = (u[:, :, None] * u[:, None, :]).reshape(len(u), k * k)
                total += np.concatenate([(m.T @ outer).ravel(), ((x * m).T @ u).ravel(), m.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

        rows = cells.select("cells").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        if not rows:
            return v
        flat = np.array([r["s"] for r in rows])
        a, b, n = flat[: p * k * k].reshape(p, k, k), flat[p * k * k : -p].reshape(p, k), flat[-p:]
        # The penalty of a column grows with its cells, so that both sides together cut off what noise alone would explain.
        v = np.linalg.solve(a + ridge * np.maximum(n, 1.0)[:, None, None] * np.eye(k), b[:, :, None])[:, :, 0]
    return v


def fill_from_similar(
    df: DataFrame,
    group: str,
    time: str,
    numbers: Sequence[str],
    texts: Sequence[str],
    arrived: str,
    row_key: Sequence[str],
    rank: int = RANK,
    passes: int = PASSES,
    ridge: float = RIDGE,
    filled: str = "filled",
) -> DataFrame:
    """Fill the missing cells of ``numbers`` and ``texts`` from records of the same group, else near in time, and mark them.

    Rows that differ in ``arrived`` only are repeats of one record and give one row (the earliest). A cell is missing if it is NULL, not
    finite, blank, or a stand-in (see the fixed values above); zero is a value.

    Cells are encoded as numbers relative to a base: a numeric cell as its distance from the mean of its group, a text column
    as one indicator per category, relative to the category's share in the group, both over their spread. Group means lean on the mean of the same day
    (``time``, UTC) where the group has few values, and stand on it where it has none; days without values, and rows without a time, use
    the whole table. Alternating least squares then explains what is left by ``rank`` factors per record and per encoded column,
    from all observed cells. A missing numeric cell is decoded to base + fit, kept within the range its scope holds; a missing text cell to the
    likeliest category of the column. A text column with more than MOST_CATEGORIES distinct values has no cells in the fit: its missing cells take the
    most frequent value of their group (else day, else table; ties: the greatest).

    Result: all columns with missing cells filled, and ``filled``, a map from the column filled to its scope: ``group`` (another
    record of the group has a value), ``day``, ``all``, or ``none`` (the table holds no value of this column: the cell is NULL).
    ``row_key`` (for instance the record's id) only spreads the rows of hot groups over tasks. Empty table: no rows.
    """
    columns = [c for c in df.columns if c != arrived]
    once = df.groupBy(*columns).agg(F.min(arrived).alias(arrived)).select(*df.columns)
    fields = [*numbers, *texts]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    clean = {f"n{i}": present_number(q(c)) for i, c in enumerate(numbers)} | {f"t{i}": present_text(q(c)) for i, c in enumerate(texts)}
    base = once.select(F.struct(*[q(c) for c in df.columns]).alias("row"), q(group).alias("g"), F.floor(micros(q(time)) / 86_400_000_000).cast("int").alias("d"), *[v.alias(n) for n, v in clean.items()])
    base = base.withColumn("k", F.xxhash64(*[F.col("row")[c] for c in row_key]))
    base = checkpointed(base)

    categories: list[list[str]] = []
    many: list[int] = []
    for i in range(len(texts)):
        some = base.where(f"t{i} is not null").groupBy(f"t{i}").count().orderBy(F.desc("count"), f"t{i}").limit(MOST_CATEGORIES + 1).collect()
        if len(some) > MOST_CATEGORIES:
            many.append(i)
        categories.append([] if i in many else [r[0] for r in some])
    # Encoded columns: numbers, then the indicators of each text column.
    encoded = [(f"n{i}", F.col(f"n{i}")) for i in range(len(numbers))]
    for i, cats in enumerate(categories):
        encoded += [(f"t{i}_{j}", F.when(F.col(f"t{i}").isNotNull(), (F.col(f"t{i}") == c).cast("double"))) for j, c in enumerate(cats)]
    names = [n for n, _ in encoded]
    p = len(names)
    if not p and not many:
        return once.withColumn(filled, F.create_map().cast("map<string,string>"))

    def stats(by: list[str], prefix: str) -> DataFrame:
        per = [F.avg(e).alias(f"{prefix}m_{n}") for n, e in encoded] + [F.count(e).alias(f"{prefix}c_{n}") for n, e in encoded]
        ends = [x for i in range(len(numbers)) for x in (F.min(f"n{i}").alias(f"{prefix}lo_n{i}"), F.max(f"n{i}").alias(f"{prefix}hi_n{i}"))]
        return base.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{prefix}rows"), *per, *ends)

    def with_modes(per: DataFrame, by: str) -> DataFrame:
        """Beside a group's (day's) statistics, the most frequent value of each text column that has many."""
        for i in many:
            counts = base.where(f"t{i} is not null and {by} is not null").groupBy(by, f"t{i}").count()
            per = per.join(counts.groupBy(by).agg(F.max_by(f"t{i}", F.struct("count", f"t{i}")).alias(f"{by}mode{i}")), by, "left")
        return per

    by_group = checkpointed(with_modes(stats(["g"], "g").where("g is not null"), "g"))
    by_day = checkpointed(with_modes(stats(["d"], "d").where("d is not null"), "d"))
    whole = stats([], "a")
    everything = whole.collect()[0].asDict()
    modes = {i: base.where(f"t{i} is not null").groupBy(f"t{i}").count().agg(F.max_by(f"t{i}", F.struct("count", f"t{i}"))).collect()[0][0] for i in many}
    rows = salted_join(base, by_group, ["g"], "grows", ["k"])
    rows = salted_join(rows, by_day, ["d"], "drows", ["k"])

    # The base of each encoded column, its scale, and the encoded residual cells (NaN where missing).
    cells, bases = [], []
    for n, e in encoded:
        top = F.lit(everything[f"am_{n}"]).cast("double")
        day = F.when(F.coalesce(F.col(f"dc_{n}"), F.lit(0)) > 0, F.col(f"dm_{n}")).otherwise(top)
        count = F.coalesce(F.col(f"gc_{n}"), F.lit(0))
        b = F.when(count > 0, (F.col(f"gm_{n}") * count + day * SHRINK) / (count + SHRINK)).otherwise(day)
        bases.append(b)
        cells.append((e - b).alias(f"x_{n}"))
    # Every encoded column is scaled by its spread around its base, so that no column outweighs the others in the fit.
    rest = {} if not p else rows.select(*cells).agg(*[F.sqrt(F.avg(F.col(f"x_{n}") * F.col(f"x_{n}"))).alias(n) for n in names]).collect()[0].asDict()
    scales = [float(rest[n] or 1.0) or 1.0 for n in names]
    cells = [F.coalesce((e - b) / s, F.lit(float("nan"))) for (_, e), b, s in zip(encoded, bases, scales)]
    cells, bases = (F.array(*x).cast("array<double>") for x in (cells, bases))
    rows = checkpointed(rows.select("row", "g", "d", *clean, cells.alias("cells"), bases.alias("bases"), *[f"{x}mode{i}" for x in "gd" for i in many], *[f"{x}c_{n}" for x in "gd" for n in names], *[f"{x}{e}_n{i}" for x in "gd" for e in ("lo", "hi") for i in range(len(numbers))]))
    v = fit_factors(rows, p, rank, passes, ridge) if p else np.zeros((0, rank))

    # Only the cells pass through Python; the record stays where it is.
    @F.pandas_udf("array<double>")
    def fitted(given: pd.Series) -> pd.Series:
        x = np.vstack(given.to_numpy()).astype(float) if len(given) else np.zeros((0, p))
        m = ~np.isnan(x)
        return pd.Series(list(_solve(v, np.where(m, x, 0.0), m.astype(float), ridge) @ v.T))

    both = rows.withColumn("fit", fitted("cells")) if p else rows.withColumn("fit", F.col("cells"))

    place = {n: i for i, n in enumerate(names)}
    out: dict[str, Column] = {}
    scope: dict[str, Column] = {}
    for i, c in enumerate(numbers):
        n = f"n{i}"
        at = place[n]
        in_group = F.coalesce(F.col(f"gc_{n}"), F.lit(0)) > 0
        in_day = F.coalesce(F.col(f"dc_{n}"), F.lit(0)) > 0
        some = everything[f"ac_{n}"] > 0
        guess = F.col("bases")[at] + F.col("fit")[at] * scales[at]
        lo = F.when(in_group, F.col(f"glo_{n}")).when(in_day, F.col(f"dlo_{n}")).otherwise(F.lit(everything[f"alo_{n}"]).cast("double"))
        hi = F.when(in_group, F.col(f"ghi_{n}")).when(in_day, F.col(f"dhi_{n}")).otherwise(F.lit(everything[f"ahi_{n}"]).cast("double"))
        out[c] = F.coalesce(F.col(n), F.least(hi, F.greatest(lo, guess)) if some else F.lit(None).cast("double"))
        scope[c] = F.when(F.col(n).isNull(), F.when(in_group, "group").when(in_day, "day").otherwise("all" if some else "none"))
    for i, c in enumerate(texts):
        n = f"t{i}"
        cats = categories[i]
        if i in many:
            out[c] = F.coalesce(F.col(n), F.col(f"gmode{i}"), F.col(f"dmode{i}"), F.lit(modes[i]))
            scope[c] = F.when(F.col(n).isNull(), F.when(F.col(f"gmode{i}").isNotNull(), "group").when(F.col(f"dmode{i}").isNotNull(), "day").otherwise("all"))
            continue
        if not cats:
            out[c], scope[c] = F.lit(None).cast("string"), F.when(F.col(n).isNull(), F.lit("none"))
            continue
        at = [place[f"{n}_{j}"] for j in range(len(cats))]
        first = f"{n}_0"  # all indicators of a text column are present together
        in_group = F.coalesce(F.col(f"gc_{first}"), F.lit(0)) > 0
        in_day = F.coalesce(F.col(f"dc_{first}"), F.lit(0)) > 0
        best = F.greatest(*[F.struct((F.col("bases")[a] + F.col("fit")[a] * scales[a]).alias("s"), F.lit(-j).alias("j")) for j, a in enumerate(at)]) if len(at) > 1 else F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("j"))
        guess = F.element_at(F.array(*[F.lit(x) for x in cats]), (1 - best["j"]).cast("int"))
        out[c] = F.coalesce(F.col(n), guess)
        scope[c] = F.when(F.col(n).isNull(), F.when(in_group, "group").when(in_day, "day").otherwise("all"))
    marks = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), scope[c].alias("value")) for c in fields]), lambda e: e["value"].isNotNull()))
    return both.select(*[(out[c] if c in out else F.col("row")[c]).alias(c) for c in df.columns], marks.alias(filled))
