"""Which features matter for a target: one univariate test per feature, then control of the false discovery rate.

Everything runs on rows (id, variable, value) joined to a target (id, y); the matrix is not needed. Tests are grouped aggregates
over the rows of each variable that give sufficient statistics; only their tail probabilities are Python, on one row per (label, variable).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from chronofold.functions import tests_of_significance as tests
from chronofold.util import checkpointed, private_names

FDR_LEVEL = 0.05


def melt(matrix: DataFrame, column_id: str = "id") -> DataFrame:
    """Matrix -> rows (id, variable, value)."""
    cols = [c for c in matrix.columns if c != column_id]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), q(c).cast("double").alias("value")) for c in cols]))
    return matrix.select(q(column_id).alias("id"), pairs.alias("p")).select("id", "p.variable", "p.value")


def infer_ml_task(y: DataFrame, column: str = "y") -> str:
    """Whole numbers, texts and truth values: classification; other numbers: regression."""
    kind = dict(y.dtypes)[column]
    return "regression" if kind in ("double", "float") or kind.startswith("decimal") else "classification"


def feature_types(features: DataFrame) -> DataFrame:
    """(variable, type): constant, binary or real, by the number of distinct values."""
    ends = features.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    kinds = features.join(ends, "variable").groupBy("variable").agg(F.count_if((F.col("value") != F.col("_lo")) & (F.col("value") != F.col("_hi"))).alias("_in"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return kinds.select("variable", F.when(F.col("_lo") == F.col("_hi"), "constant").when(F.col("_in") == 0, "binary").otherwise("real").alias("type"))


def value_counts(features: DataFrame, y: DataFrame) -> DataFrame:
    """(variable, value, label, n): all that the tests with a label need."""
    return features.join(y.select("id", F.col("y").cast("string").alias("label")), "id").groupBy("variable", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def rank_statistics(counts: DataFrame) -> DataFrame:
    """(label, variable, n1, n2, u, ties): Mann-Whitney U of each label against the rest, from middle ranks."""
    at = counts.groupBy("variable", "value").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("variable").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = F.col("t").cast("double")
    ranks = at.withColumn("mid", before + (t + 1) / 2)
    ties = ranks.groupBy("variable").agg(F.sum(t * t * t - t).alias("ties"), F.sum("t").alias("all"))
    sums = counts.join(ranks, ["variable", "value"]).groupBy("label", "variable").agg(F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("mid")).alias("r"))
    return sums.join(ties, "variable").select("label", "variable", "n1", (F.col("all") - F.col("n1")).alias("n2"), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "ties")


def distance_statistics(counts: DataFrame) -> DataFrame:
    """(label, variable, n1, n2, d): greatest distance between the distributions of a label and of the rest."""
    whole = counts.groupBy("variable", "value").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("of"))
    labels = counts.groupBy("variable").agg(F.collect_set("label").alias("labels"))
    dense = whole.join(labels, "variable").select("variable", "value", "t", F.explode("labels").alias("label"), "of")
    dense = dense.withColumn("n", F.coalesce(F.element_at("of", F.col("label")), F.lit(0)))
    w = Window.partitionBy("variable", "label")
    so_far = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    n1 = F.sum("n").over(w)
    n2 = F.sum("t").over(w) - n1
    gap = F.abs(F.try_divide(F.sum("n").over(so_far), n1) - F.try_divide(F.sum("t").over(so_far) - F.sum("n").over(so_far), n2))
    rows = dense.select("label", "variable", n1.alias("n1"), n2.alias("n2"), gap.alias("gap"))
    return rows.groupBy("label", "variable").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("gap").alias("d"))


def contingency(counts: DataFrame) -> DataFrame:
    """(label, variable, a, b, c, d) for binary features: label with the high and low value, the rest with them."""
    ends = counts.groupBy("variable").agg(F.max("value").alias("hi"), F.sum("n").alias("all"))
    high = counts.join(ends, "variable")
    tops = high.groupBy("variable").agg(F.sum(F.when(F.col("value") == F.col("hi"), F.col("n")).otherwise(0)).alias("tops"), F.max("all").alias("all"))
    per = high.groupBy("label", "variable").agg(F.sum(F.when(F.col("value") == F.col("hi"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n1"))
    return per.join(tops, "variable").select(
        "label", "variable", "a", (F.col("n1") - F.col("a")).alias("b"), (F.col("tops") - F.col("a")).alias("c"), (F.col("all") - F.col("n1") - (F.col("tops") - F.col("a"))).alias("d")
    )


def split_distances(features: DataFrame, y: DataFrame) -> DataFrame:
    """(variable, n1, n2, d) for binary features and a real target: distance between the targets of the two values."""
    rows = features.join(y.select("id", F.col("y").cast("double").alias("y")), "id")
    top = F.max("value").over(Window.partitionBy("variable"))
    at = rows.withColumn("up", (F.col("value") == top).cast("long")).groupBy("variable", "y").agg(F.sum("up").alias("n"), F.count(F.lit(1)).alias("t"))
    w = Window.partitionBy("variable")
    so_far = w.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    n1 = F.sum("n").over(w)
    n2 = F.sum("t").over(w) - n1
    gap = F.abs(F.try_divide(F.sum("n").over(so_far), n1) - F.try_divide(F.sum("t").over(so_far) - F.sum("n").over(so_far), n2))
    return at.select("variable", n1.alias("n1"), n2.alias("n2"), gap.alias("gap")).groupBy("variable").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("gap").alias("d"))


def concordance(features: DataFrame, y: DataFrame) -> DataFrame:
    """(variable, n, discordant, tie sums of value, of y, of both) for Kendall's tau.

    Discordant pairs are inversions of y's ranks in the order of the values. They are counted bit by bit: two ranks differ first in one
    bit, and at that bit, among ranks with the same higher bits, an inversion is a one before a zero. A row is copied once per bit, and one windowed sum
    counts the ones before each zero: n log n rows, no pair is ever formed.
    """
    rows = features.join(y.select("id", F.col("y").cast("double").alias("y")), "id").select("variable", "value", "y")
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("variable").orderBy("y")) - 1)
    ranked = ranked.withColumn("bits", F.length(F.bin(F.max("r").over(Window.partitionBy("variable")).cast("long"))))
    bit = F.explode(F.sequence(F.lit(0), F.col("bits") - 1))
    split = ranked.select("variable", "value", "r", bit.alias("b")).select("variable", "value", "r", "b", F.expr("r >> (b + 1)").alias("above"), F.expr("(r >> b) & 1").alias("one"))
    ones = F.sum("one").over(Window.partitionBy("variable", "b", "above").orderBy("value", "r").rowsBetween(Window.unboundedPreceding, -1))
    wrong = split.withColumn("ones", ones).groupBy("variable").agg(F.sum(F.when(F.col("one") == 0, F.coalesce("ones", F.lit(0))).otherwise(0)).alias("discordant"))

    def ties(by: list[str], p: str) -> DataFrame:
        t = F.col("t").cast("double")
        return rows.groupBy("variable", *by).agg(F.count(F.lit(1)).alias("t")).groupBy("variable").agg(
            F.sum("t").alias(f"n{p}"), F.sum(t * (t - 1) / 2).alias(f"{p}0"), F.sum(t * (t - 1) * (t - 2)).alias(f"{p}1"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{p}2")
        )

    every = wrong.join(ties(["value"], "x"), "variable").join(ties(["y"], "y").drop("ny"), "variable").join(ties(["value", "y"], "b").select("variable", F.col("b0").alias("both")), "variable")
    return every.withColumnRenamed("nx", "n")


@F.pandas_udf(DoubleType())
def _p_mann(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([tests.mann_whitney(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties)])


@F.pandas_udf(DoubleType())
def _p_smirnov(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([tests.kolmogorov_smirnov(a if a == a else 0.0, int(b), int(c)) for a, b, c in zip(d, n1, n2)])


@F.pandas_udf(DoubleType())
def _p_fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([tests.fisher_exact(*map(int, x)) for x in zip(a, b, c, d)])


@F.pandas_udf(DoubleType())
def _p_kendall(n: pd.Series, dis: pd.Series, x0: pd.Series, x1: pd.Series, x2: pd.Series, y0: pd.Series, y1: pd.Series, y2: pd.Series, both: pd.Series) -> pd.Series:
    return pd.Series([tests.kendall(q[1], int(q[0]), q[2:5], q[5:8], q[8]) for q in zip(n, dis, x0, x1, x2, y0, y1, y2, both)])


#: Sums of 1 / i for i up to 0, 1, .., 64.
_HARMONIC = [math.fsum(1 / i for i in range(1, m + 1)) for m in range(65)]


def harmonic(m: Column) -> Column:
    """The sum of 1 / i for i up to m in one step: beyond 64 by its expansion, whose next term is under 1e-20."""
    x = m.cast("double")
    far = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * x * x * x * x * x * x)
    return F.when(m > 64, far).otherwise(F.get(F.array(*map(F.lit, _HARMONIC)), F.least(m, F.lit(64)).cast("int")))


def control_false_discoveries(table: DataFrame, level: float = FDR_LEVEL, independent: bool = False, p: str = "p_value", within: str | None = None) -> DataFrame:
    """Add ``relevant``: rejected by Benjamini-Hochberg (``independent``) or Benjamini-Yekutieli at ``level``. Rows without a p-value are irrelevant and not counted.

    What is rejected is all up to a greatest p-value, one a group. Those are found on the counts of distinct p-values; the table itself is not ordered.
    """
    name = private_names(*table.columns)
    group, value, least = name("_group"), name("_value"), name("_least")
    key = F.col(within) if within else F.lit(1)
    real = F.col(p).isNotNull() & ~F.isnan(p)
    counts = table.where(real).groupBy(key.alias(group), F.col(p).alias(value)).agg(F.count(F.lit(1)).alias("t"))
    rank, m = F.sum("t").over(Window.partitionBy(group).orderBy(value)), F.sum("t").over(Window.partitionBy(group))
    ranked = counts.select(group, value, rank.alias("rank"), m.alias("m"))
    c = F.lit(1.0) if independent else harmonic(F.col("m"))
    limits = ranked.where(F.col(value) <= F.col("rank") * level / (F.col("m") * c)).groupBy(group).agg(F.max(value).alias(least))
    # A row a group.
    joined = table.join(F.broadcast(limits), key.eqNullSafe(F.col(group)), "left")
    return joined.withColumn("relevant", F.coalesce(real & (F.col(p) <= F.col(least)), F.lit(False))).drop(group, least)


def check_alignment(X: DataFrame, y: DataFrame) -> None:
    """X and y must have the same ids, and y one row per id. One pass over the ids."""
    ids = X.select("id").withColumn("_x", F.lit(1)).distinct().unionByName(y.select("id").withColumn("_y", F.lit(1)), allowMissingColumns=True)
    bad = ids.groupBy("id").agg(F.count("_x").alias("x"), F.count("_y").alias("y")).where("x <> 1 or y <> 1 or id is null").limit(5).collect()
    if bad:
        raise ValueError(f"X and y do not have the same ids, each once in y, such as {[r['id'] for r in bad]}")


def calculate_relevance_table(
    X: DataFrame,
    y: DataFrame,
    ml_task: str = "auto",
    multiclass: bool = False,
    n_significant: int = 1,
    test_for_binary_target_real_feature: str = "mann",
    fdr_level: float = FDR_LEVEL,
    hypotheses_independent: bool = False,
    test_for_binary_target_binary_feature: str = "fisher",
    test_for_real_target_binary_feature: str = "mann",
    test_for_real_target_real_feature: str = "kendall",
    **scheduling: object,
) -> DataFrame:
    """(feature, type, p_value, relevant) of every feature; with ``multiclass`` p_value_L and relevant_L per label and n_significant.

    ``X``: a matrix with ``id``, or rows (id, variable, value). ``y``: (id, y), one row per id. Ids must be the same in both, else it is an error; so are unknown
    options (those about processes are ignored). Classification tests each label against the rest and
    calls a feature relevant if it is for any label, with its smallest p; constants are irrelevant and have no p-value.
    """
    if ml_task not in ("auto", "classification", "regression"):
        raise ValueError("ml_task must be auto, classification or regression")
    if test_for_binary_target_real_feature not in ("mann", "smir"):
        raise ValueError("the test must be mann or smir")
    only = {"test_for_binary_target_binary_feature": (test_for_binary_target_binary_feature, "fisher"), "test_for_real_target_binary_feature": (test_for_real_target_binary_feature, "mann"), "test_for_real_target_real_feature": (test_for_real_target_real_feature, "kendall")}
    if wrong := [f"{k}={got!r}" for k, (got, known) in only.items() if got != known]:
        raise ValueError(f"unknown tests: {wrong}")
    if unknown := set(scheduling) - {"n_jobs", "chunksize", "show_warnings"}:
        raise TypeError(f"unknown options: {sorted(unknown)}")
    check_alignment(X, y)
    if ml_task == "auto":
        ml_task = infer_ml_task(y)
    # Used several times below, and small beside the series it was extracted from.
    features = checkpointed(X if X.columns == ["id", "variable", "value"] else melt(X))
    kinds = checkpointed(feature_types(features))
    of = lambda t: features.join(F.broadcast(kinds.where(F.col("type") == t).select("variable")), "variable", "left_semi")
    if ml_task == "regression":
        if multiclass:
            raise AssertionError("multiclass needs a classification")
        real = concordance(of("real"), y)
        real = real.select(F.lit(None).cast("string").alias("label"), "variable", _p_kendall("n", "discordant", "x0", "x1", "x2", "y0", "y1", "y2", "both").alias("p_value"))
        binary = split_distances(of("binary"), y).select(F.lit(None).cast("string").alias("label"), "variable", _p_smirnov("d", "n1", "n2").alias("p_value"))
    else:
        counts = checkpointed(value_counts(features.join(F.broadcast(kinds.where("type <> 'constant'").select("variable")), "variable", "left_semi"), y))
        typed = lambda t: counts.join(F.broadcast(kinds.where(F.col("type") == t).select("variable")), "variable", "left_semi")
        if test_for_binary_target_real_feature == "mann":
            real = rank_statistics(typed("real")).select("label", "variable", _p_mann("u", "n1", "n2", "ties").alias("p_value"))
        else:
            real = distance_statistics(typed("real")).select("label", "variable", _p_smirnov("d", "n1", "n2").alias("p_value"))
        binary = contingency(typed("binary")).select("label", "variable", _p_fisher("a", "b", "c", "d").alias("p_value"))
    tested = checkpointed(control_false_discoveries(checkpointed(real.unionByName(binary)), fdr_level, hypotheses_independent, within="label"))
    labels = sorted(r[0] for r in tested.select("label").distinct().collect() if r[0] is not None)
    if multiclass and n_significant > len(labels):
        raise AssertionError("n_significant must not exceed the number of classes")
    if multiclass and len(labels) > 2:
        aggs = [x for v in labels for x in (F.max(F.when(F.col("label") == v, F.col("p_value"))).alias(f"p_value_{v}"), F.max(F.when(F.col("label") == v, F.col("relevant"))).alias(f"relevant_{v}"))]
        out = tested.groupBy("variable").agg(*aggs, F.count_if("relevant").alias("n_significant"))
        out = kinds.join(out, "variable", "left")
        filled = [F.coalesce(F.col(f"`relevant_{v}`"), F.lit(False)).alias(f"relevant_{v}") for v in labels]
        n = F.coalesce("n_significant", F.lit(0))
        return out.select(F.col("variable").alias("feature"), "type", *[F.col(f"`p_value_{v}`") for v in labels], *filled, n.alias("n_significant"), ((F.col("type") != "constant") & (n >= n_significant)).alias("relevant"))
    one = tested.groupBy("variable").agg(F.min("p_value").alias("p_value"), F.max("relevant").alias("relevant"))
    return kinds.join(one, "variable", "left").select(F.col("variable").alias("feature"), "type", "p_value", F.coalesce("relevant", F.lit(False)).alias("relevant"))


def select_features(X: DataFrame, y: DataFrame, **options: object) -> DataFrame:
    """The matrix with its relevant columns only. Missing values are an error, as is a target with one value."""
    from chronofold.operators.impute import check_for_nans_in_columns

    check_for_nans_in_columns(X)
    sizes = X.agg(F.count(F.lit(1))).collect()[0][0], y.agg(F.count(F.lit(1)), F.countDistinct("y")).collect()[0]
    if sizes[0] <= 1 or sizes[0] != sizes[1][0]:
        raise AssertionError("X and y must have the same ids, more than one")
    if sizes[1][1] < 2:
        raise AssertionError("the target has one value only")
    table = calculate_relevance_table(X, y, **options)
    keep = {r[0] for r in table.where("relevant").select("feature").collect()}
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return X.select("id", *[q(c) for c in X.columns if c in keep])
