"""Entity-attribute-value rows into one wide, typed row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of "no value", of true and of false, and the shape of a number.
NO_VALUE = ("", "nan", "na", "null", "none")
TRUE_WORDS = ("true", "t", "yes", "y")
FALSE_WORDS = ("false", "f", "no", "n")
NUMBER = r"^[+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:e[+-]?[0-9]+)?$"
INFINITY = r"^[+-]?inf(?:inity)?$"
#: White space as text exports know it: ASCII, the Unicode spaces, and the byte order mark.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

_KINDS = {"boolean", "bigint", "double"}


def _clean(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + "$", ""))


def typed_cells(df: DataFrame, entity: str, attribute: str, value: str, arrived: str, types: DataFrame) -> DataFrame:
    """One row per cell (entity, attribute): the typed value that stands, and what was wrong.

    ``types`` lists ``variable`` and ``dtype`` (boolean, bigint, double). Rows whose entity is NULL or whose attribute is NULL or
    not listed are no cells. A cell's readable values of one type are compared as typed values; where they
    differ, the one that arrived last stands (ties: the greatest), and ``conflict`` is true. ``unreadable`` is true where
    the cell has no readable value and at least one unreadable one. A cell of missing values only has NULL and neither mark.
    A number beyond the type's range is unreadable. -0 equals 0.
    """
    raw = _clean(F.col(value).cast("string"))
    names = types.select(F.col("variable").alias("_attribute"), F.col("dtype").alias("_dtype"))
    rows = df.select(F.col(entity).alias("_entity"), F.col(attribute).alias("_attribute"), raw.alias("_raw"), F.col(arrived).alias("_at")).where(
        "_entity is not null"
    )
    # Rows that say the same about a cell are one row with the latest arrival: a cell delivered a million times costs one.
    # The list of attributes is bounded by the width of the result, so it is broadcast.
    rows = rows.groupBy("_entity", "_attribute", "_raw").agg(F.max("_at").alias("_at")).join(F.broadcast(names), "_attribute")
    r = F.col("_raw")
    missing = r.isNull() | r.isin(*NO_VALUE)
    plain = F.regexp_replace(r, ",", ".")
    number = F.when(r.rlike(NUMBER), plain.try_cast("double"))
    number = F.when(F.abs(number) != F.lit(float("inf")), number)
    exact = F.when(r.rlike(NUMBER), plain.try_cast("decimal(38,15)"))
    whole = F.when(exact == F.floor(exact), exact.try_cast("bigint"))
    # Exponents may carry a whole number past what decimal(38,15) holds while still within a bigint's range; doubles that
    # large have no fractional part.
    whole = F.coalesce(whole, F.when((F.abs(number) >= 2.0**53) & (F.abs(number) < 2.0**63) & (number == F.floor(number)), number.try_cast("bigint")))
    infinite = F.when(r.rlike(INFINITY), F.when(r.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    truth = F.when(r.isin(*TRUE_WORDS) | (number == 1), F.lit(True)).when(r.isin(*FALSE_WORDS) | (number == 0), F.lit(False))
    kind = F.col("_dtype")
    marked = rows.select(
        "_entity",
        "_attribute",
        "_at",
        missing.alias("_missing"),
        F.when(~missing & (kind == "double"), F.coalesce(number, infinite) + F.lit(0.0)).alias("_double"),
        F.when(~missing & (kind == "bigint"), whole).alias("_bigint"),
        F.when(~missing & (kind == "boolean"), truth).alias("_boolean"),
    )
    typed = F.struct("_double", "_bigint", "_boolean")
    readable = F.col("_double").isNotNull() | F.col("_bigint").isNotNull() | F.col("_boolean").isNotNull()
    cells = marked.groupBy("_entity", "_attribute").agg(
        F.max(F.when(readable, F.struct("_at", typed.alias("t")))).alias("stands"),
        F.min(F.when(readable, typed)).alias("least"),
        F.max(F.when(readable, typed)).alias("most"),
        F.max(~readable & ~F.col("_missing")).alias("odd"),
    )
    return cells.select(
        "_entity",
        "_attribute",
        F.col("stands.t._double").alias("_double"),
        F.col("stands.t._bigint").alias("_bigint"),
        F.col("stands.t._boolean").alias("_boolean"),
        F.coalesce(F.col("least") != F.col("most"), F.lit(False)).alias("_conflict"),
        (F.col("least").isNull() & F.col("odd")).alias("_unreadable"),
    )


def widen(df: DataFrame, types: DataFrame, entity: str = "column_id", attribute: str = "variable", value: str = "value", arrived: str = "loaded_at", flags: bool = False) -> DataFrame:
    """One row per entity with one typed column per attribute listed in ``types`` (``variable``, ``dtype``).

    The attribute list is discovered first (one small action: it is the result's schema); then each attribute is
    one conditional aggregate over the cells of ``typed_cells``, whose rules for repeats, conflicts and casts hold.
    Entities whose rows hold no listed attribute still have a row, all NULL. Entity NULL: no row. Empty table: no rows.

    With ``flags`` each column is a struct (value, conflict, unreadable) instead of the bare value.
    """
    listed = types.where("variable is not null").select("variable", "dtype").distinct().orderBy("variable").collect()
    if bad := [x for x in listed if x["dtype"] not in _KINDS]:
        raise ValueError(f"unknown types: {bad[:5]}")
    if len({x["variable"].lower() for x in listed}) < len(listed) or entity.lower() in {x["variable"].lower() for x in listed}:
        raise ValueError("the attributes give clashing columns")
    cells = typed_cells(df, entity, attribute, value, arrived, types.where("variable is not null").select("variable", "dtype").distinct())
    # Entities without any listed attribute come in as a bare key.
    keys = df.select(F.col(entity).alias("_entity")).where("_entity is not null").distinct()
    every = cells.unionByName(keys, allowMissingColumns=True)
    aggs = []
    for x in listed:
        here = F.col("_attribute") == x["variable"]
        of = F.col(f"_{x['dtype']}")
        what = F.struct(of.alias("value"), F.col("_conflict").alias("conflict"), F.col("_unreadable").alias("unreadable")) if flags else of
        aggs.append(F.max(F.when(here, what)).alias(x["variable"]))
    if not aggs:
        return keys.withColumnRenamed("_entity", entity)
    return every.groupBy("_entity").agg(*aggs).withColumnRenamed("_entity", entity)


def cell_issues(wide: DataFrame, entity: str = "column_id") -> DataFrame:
    """(entity, variable, issue) of every marked cell of a wide table made with ``flags``."""
    q = lambda n: "`" + n.replace("`", "``") + "`"
    marks = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(q(c) + ".conflict").alias("conflict"), F.col(q(c) + ".unreadable").alias("unreadable")) for c in wide.columns if c != entity])
    return (
        wide.select(entity, F.explode(F.filter(marks, lambda m: m["conflict"] | m["unreadable"])).alias("m"))
        .select(entity, F.col("m.variable").alias("variable"), F.when(F.col("m.conflict"), F.lit("conflict")).otherwise(F.lit("unreadable")).alias("issue"))
    )
