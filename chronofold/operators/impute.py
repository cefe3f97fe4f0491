"""Replacing values that are not finite, and small checks on frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
#: NULL stands for NaN: both are replaced alike.


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number_columns(df: DataFrame, ignore: Sequence[str] = ("id",)) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float") and c not in ignore]


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def get_range_values_per_column(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """(maximum, minimum, median) of the finite values of each column, in one pass; 0 for a column without any.

    The exact median keeps the counts of a column's distinct values in one state; with ``accuracy`` it is a sketch of bounded size whose rank is
    off by at most 1 / accuracy of the rows.
    """
    median = F.median if accuracy is None else lambda c: F.percentile_approx(c, 0.5, accuracy)
    columns = list(columns if columns is not None else number_columns(df))
    if not columns:
        return {}, {}, {}
    aggs = [f(finite(_q(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.max), ("b", F.min), ("c", median))]
    got = df.agg(*aggs).collect()[0].asDict()
    return tuple({c: float(got[f"{n}{i}"]) if got[f"{n}{i}"] is not None else 0.0 for i, c in enumerate(columns)} for n in "abc")


def impute_dataframe_range(df: DataFrame, col_to_max: Mapping[str, float], col_to_min: Mapping[str, float], col_to_median: Mapping[str, float], columns: Sequence[str] | None = None) -> DataFrame:
    """+infinity -> maximum, -infinity -> minimum, NaN and NULL -> median, as given; every number column (or of ``columns``) needs all three, finite."""
    columns = list(columns if columns is not None else number_columns(df))
    for given in (col_to_max, col_to_min, col_to_median):
        if missing := [c for c in columns if c not in given]:
            raise ValueError(f"no replacement for {missing}")
        if bad := [c for c in columns if not abs(given[c]) < INF]:
            raise ValueError(f"replacements must be finite: {bad}")
    new = {c: F.when(_q(c).isNull() | F.isnan(_q(c)), float(col_to_median[c])).when(_q(c) == F.lit(INF), float(col_to_max[c])).when(_q(c) == F.lit(-INF), float(col_to_min[c])).otherwise(_q(c)) for c in columns}
    return df.select(*[new[c].alias(c) if c in new else _q(c) for c in df.columns])


def impute(df: DataFrame) -> DataFrame:
    """As ``impute_dataframe_range`` with the columns' own finite ranges; a column without finite values becomes 0."""
    return impute_dataframe_range(df, *get_range_values_per_column(df))


def impute_dataframe_zero(df: DataFrame) -> DataFrame:
    """Everything that is not finite becomes 0."""
    columns = set(number_columns(df))
    return df.select(*[F.coalesce(finite(_q(c)), F.lit(0.0)).alias(c) if c in columns else _q(c) for c in df.columns])


def impute_long(features: DataFrame) -> DataFrame:
    """``impute`` on rows (id, variable, value): grouped statistics, no wide frame."""
    v = F.col("value")
    stats = features.groupBy("variable").agg(F.max(finite(v)).alias("_a"), F.min(finite(v)).alias("_b"), F.median(finite(v)).alias("_c"))
    rows = features.join(stats, "variable")
    value = F.when(v.isNull() | F.isnan(v), F.coalesce("_c", F.lit(0.0))).when(v == F.lit(INF), F.coalesce("_a", F.lit(0.0))).when(v == F.lit(-INF), F.coalesce("_b", F.lit(0.0))).otherwise(v)
    return rows.select("id", "variable", value.alias("value"))


def check_for_nans_in_columns(df: DataFrame, columns: Sequence[str] | None = None) -> None:
    """ValueError naming the columns that hold NaN or NULL."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    bad = [F.count_if(_q(c).isNull() | (F.isnan(_q(c)) if types[c] in ("double", "float") else F.lit(False))).alias(f"c{i}") for i, c in enumerate(columns)]
    got = df.agg(*bad).collect()[0]
    if wrong := [c for i, c in enumerate(columns) if got[f"c{i}"]]:
        raise ValueError(f"missing values in {wrong}")


def get_ids(df_or_dict: DataFrame | Mapping[str, DataFrame], column_id: str) -> DataFrame:
    """The distinct ids, as a frame with the column ``id``."""
    frames = df_or_dict.values() if isinstance(df_or_dict, Mapping) else [df_or_dict]
    out = None
    for f in frames:
        if not isinstance(f, DataFrame):
            raise TypeError("a frame or a mapping of frames is needed")
        one = f.select(_q(column_id).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def restrict_input_to_index(df_or_dict: DataFrame | Mapping[str, DataFrame], column_id: str, index: DataFrame, index_column: str = "id") -> DataFrame | dict[str, DataFrame]:
    """Rows whose id is in ``index``: a left semi join. AttributeError if none is."""
    if isinstance(df_or_dict, Mapping):
        return {k: restrict_input_to_index(v, column_id, index, index_column) for k, v in df_or_dict.items()}
    if not isinstance(df_or_dict, DataFrame):
        raise TypeError("a frame or a mapping of frames is needed")
    keys = index.select(_q(index_column).alias("_key")).distinct()
    out = df_or_dict.join(keys, _q(column_id) == F.col("_key"), "left_semi")
    if out.isEmpty():
        raise AttributeError("the ids of the series and of the index have nothing in common")
    return out
