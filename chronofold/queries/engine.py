"""Queries of the engine's relational operators: extraction forms, rolling, imputation and selection, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import settings
from chronofold.operators import impute as imp
from chronofold.operators import relevance, rolling
from chronofold.plans import pipeline
from chronofold.plans.container import to_long
from chronofold.plans.extract import extract_features
from chronofold.queries.features import DIGITS, SHIFT, rounded
from chronofold.streaming.windows import windowed_features
from chronofold.util import table

WIDE = ["l_quantity", "l_extendedprice", "l_discount"]
WIDE_SORT = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
FEATURES = ("sum_values", "mean", "length", "standard_deviation", "maximum", "minimum")


def _r(sql: str) -> str:
    return f"round({sql} + {SHIFT:.7f}, {DIGITS}) + 0.0"


def _round(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else (F.round(F.col(f"`{c}`") + SHIFT, DIGITS) + 0.0).alias(c) for c in df.columns])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")


EVENT = {"column_id": "user_id", "column_sort": ["ts", "event_id"], "column_kind": "event_type", "column_value": "value"}
MINIMAL_SQL = {
    "sum_values": "sum({v})", "median": "median({v})", "mean": "avg({v})", "length": "count({v})", "standard_deviation": "stddev_pop({v})", "variance": "var_pop({v})",
    "root_mean_square": "sqrt(avg({v} * {v}))", "maximum": "max({v})", "absolute_maximum": "max(abs({v}))", "minimum": "min({v})",
}


# --- extraction -------------------------------------------------------------------------------------------------------


def x_minimal_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(extract_features(_events(spark, d), settings.MinimalFCParameters(), pivot=False, validate=False, **EVENT))


def _minimal_sql(source: str) -> str:
    parts = [f"SELECT id, kind || '__{n}' AS variable, CAST({e.format(v='v')} AS DOUBLE) AS x FROM {source} GROUP BY id, kind" for n, e in MINIMAL_SQL.items()]
    return f"SELECT id, variable, {_r('x')} AS value FROM (" + " UNION ALL ".join(parts) + ")"


def x_minimal_wide_input(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", *WIDE_SORT, *WIDE)
    return rounded(extract_features(rows, settings.MinimalFCParameters(), column_id="l_suppkey", column_sort=WIDE_SORT, pivot=False, validate=False))


WIDE_SQL = "(" + " UNION ALL ".join(f"SELECT l_suppkey AS id, '{c}' AS kind, {c} AS v FROM lineitem" for c in WIDE) + ")"


def x_minimal_mapping_input(spark: SparkSession, d: str) -> DataFrame:
    frames = {c: table(spark, d, "lineitem").select("l_suppkey", F.col(c).alias("value")) for c in WIDE[:2]}
    return rounded(extract_features(frames, settings.MinimalFCParameters(), column_id="l_suppkey", column_value="value", pivot=False, validate=False))


def x_matrix(spark: SparkSession, d: str) -> DataFrame:
    chosen = {"mean": None, "maximum": None, "quantile": [{"q": 0.1}]}
    got = extract_features(_events(spark, d), chosen, validate=False, **EVENT)
    return _round(got.select("id", *[F.col(f"`{c}`").alias(c.replace("__", "_").replace(".", "p")) for c in got.columns[1:]]), ["id"])


KINDS = ("click", "error", "purchase", "signup", "view")
MATRIX_SQL = "SELECT user_id AS id, " + ", ".join(
    f"{_r(e.format(k=k))} AS {k}_{n}" for k in KINDS for n, e in (("mean", "avg(value) FILTER (event_type = '{k}')"), ("maximum", "max(value) FILTER (event_type = '{k}')"), ("quantile_q_0p1", "quantile_cont(value, 0.1) FILTER (event_type = '{k}')"))
) + " FROM events GROUP BY 1"


def x_comprehensive(spark: SparkSession, d: str) -> DataFrame:
    """The reference call: all calculators of all kinds, as a matrix."""
    return extract_features(_events(spark, d), validate=True, **EVENT)


def x_efficient(spark: SparkSession, d: str) -> DataFrame:
    return extract_features(_events(spark, d), settings.EfficientFCParameters(), validate=False, pivot=False, **EVENT)


def x_relevant(spark: SparkSession, d: str) -> DataFrame:
    """Extraction, imputation and selection: which features of a user's events tell whether the user's clicks are worth more than 50 on average."""
    events = _events(spark, d)
    y = events.where("event_type = 'click'").groupBy("user_id").agg((F.avg("value") > 50).cast("double").alias("y")).select(F.col("user_id").alias("id"), "y")
    rows = events.join(y.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return pipeline.extract_relevant_features(rows, y, default_fc_parameters=settings.MinimalFCParameters(), **EVENT)


def x_settings_per_kind(spark: SparkSession, d: str) -> DataFrame:
    per_kind = {"click": {"maximum": None}, "view": {"length": None, "minimum": None}}
    return rounded(extract_features(_events(spark, d), None, per_kind, pivot=False, validate=False, **EVENT))


def x_settings_from_names(spark: SparkSession, d: str) -> DataFrame:
    names = ["click__mean", "view__quantile__q_0.9", 'error__linear_trend__attr_"slope"']
    return rounded(extract_features(_events(spark, d), {}, settings.from_columns(names), pivot=False, validate=False, **EVENT))


def span(x, scale=1.0):
    """A calculator of a user's own: largest minus smallest value."""
    return float((x.max() - x.min()) * scale)


def x_custom_calculator(spark: SparkSession, d: str) -> DataFrame:
    return rounded(extract_features(_events(spark, d), {span: [{"scale": 2.0}]}, pivot=False, validate=False, **EVENT))


def x_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = windowed_features(rows, "user_id", "event_type", "ts", "value", "7 days", features=FEATURES)
    return _round(got.select(F.unix_seconds("start").alias("start"), "id", "kind", *FEATURES), ["start", "id", "kind"])


# --- rolling ----------------------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey", "o_totalprice")


def _rolled(got: DataFrame) -> DataFrame:
    return got.select(F.col("id.id").alias("customer"), F.col("id.timeshift.o_orderkey").alias("timeshift"), "o_orderkey", "o_totalprice")


def w_roll_forward(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(rolling.roll_time_series(_orders(spark, d), "o_custkey", "at", max_timeshift=3, min_timeshift=1))


def w_roll_forward_by_two(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(rolling.roll_time_series(_orders(spark, d), "o_custkey", "at", rolling_direction=2, max_timeshift=4))


def w_roll_backward(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(rolling.roll_time_series(_orders(spark, d), "o_custkey", "at", rolling_direction=-2, max_timeshift=3, min_timeshift=2))


_NUMBERED = "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"


def _roll_sql(ends: str, inside: str) -> str:
    return f"{_NUMBERED} SELECT e.o_custkey AS customer, e.o_orderkey AS timeshift, o.o_orderkey, o.o_totalprice FROM o e JOIN o ON o.o_custkey = e.o_custkey AND {inside} WHERE {ends}"


def w_roll_features(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling.roll_time_series(_orders(spark, d).select("o_custkey", "at", "o_totalprice"), "o_custkey", "at", max_timeshift=3)
    got = extract_features(rolled.select("id", F.col("at.o_orderkey").alias("k"), F.lit("price").alias("kind"), "o_totalprice"), {f: None for f in FEATURES}, column_id="id", column_sort="k", column_kind="kind", column_value="o_totalprice", pivot=False, validate=False)
    return rounded(got.select(F.col("id.id").alias("customer"), F.col("id.timeshift.o_orderkey").alias("timeshift"), "variable", "value"))


def w_moving_features(spark: SparkSession, d: str) -> DataFrame:
    got = rolling.rolling_features(_orders(spark, d), "o_custkey", "at", None, "o_totalprice", 3, 1, FEATURES)
    return _round(got.select(F.col("id").alias("customer"), F.col("timeshift.o_orderkey").alias("timeshift"), *[F.col(f).cast("double").alias(f) for f in FEATURES]), ["customer", "timeshift"])


_FRAME = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
_MOVING = {"sum_values": "sum(o_totalprice) F", "mean": "avg(o_totalprice) F", "length": "count(*) F", "standard_deviation": "stddev_pop(o_totalprice) F", "maximum": "max(o_totalprice) F", "minimum": "min(o_totalprice) F"}


def _moving(f: str) -> str:
    return _MOVING[f].replace(" F", " " + _FRAME)


MOVING_ROWS = f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, {', '.join(f'CAST({_moving(f)} AS DOUBLE) AS {f}' for f in FEATURES)} FROM orders"


def w_forecasting_frame(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "events").groupBy(F.to_date("ts").alias("time")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    frame, target = rolling.make_forecasting_frame(one, "value", 5)
    rows = frame.join(target, "id")
    return _round(rows.select(F.col("id.timeshift").cast("string").alias("timeshift"), F.col("time").cast("string").alias("time"), "value", "y"), ["timeshift", "time"])


FORECAST_SQL = f"""WITH s AS (SELECT CAST(ts AS DATE) AS time, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY time) AS rn FROM s)
SELECT CAST(e.time AS VARCHAR) AS timeshift, CAST(o.time AS VARCHAR) AS time, {_r('o.value')} AS value, {_r('e.value')} AS y FROM o e JOIN o ON o.rn BETWEEN e.rn - 5 AND e.rn - 1 WHERE e.rn > 1"""


def w_sub_series(spark: SparkSession, d: str) -> DataFrame:
    got = rolling.add_sub_time_series_index(_orders(spark, d), 4, "o_custkey", "at")
    return got.select(F.col("id.chunk").alias("chunk"), F.col("id.id").alias("customer"), "o_orderkey")


# --- imputation and frames --------------------------------------------------------------------------------------------

NUMBERS = ["a__mean", "a__standard_deviation", "a__maximum", "b__median", "b__abs_energy", "b__mean_change"]
_FINITE = "CASE WHEN isfinite({c}) THEN {c} END"


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_matrix").select("id", "loaded_at", *NUMBERS)


def _scaled(df: DataFrame) -> DataFrame:
    # Relative rounding, as one stand-in in these columns is 1e30.
    cols = [F.when(F.abs(F.col(c)) > 1e20, F.signum(c) * 1e30).otherwise(F.round(F.col(c) + SHIFT, DIGITS) + 0.0).alias(c) for c in NUMBERS]
    return df.select("id", F.unix_micros("loaded_at").alias("at"), *cols)


def _scaled_sql(e: str, c: str) -> str:
    return f"CASE WHEN abs({e}) > 1e20 THEN sign({e}) * 1e30 ELSE {_r(e)} END AS {c}"


def m_impute(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(imp.impute(_matrix(spark, d)))


_STATS = "WITH s AS (SELECT " + ", ".join(f"coalesce(max({_FINITE.format(c=c)}), 0) AS {c}_a, coalesce(min({_FINITE.format(c=c)}), 0) AS {c}_b, coalesce(median({_FINITE.format(c=c)}), 0) AS {c}_c" for c in NUMBERS) + " FROM feature_matrix)"
_IMPUTED = "CASE WHEN {c} IS NULL OR isnan({c}) THEN {c}_c WHEN {c} = 'inf'::DOUBLE THEN {c}_a WHEN {c} = '-inf'::DOUBLE THEN {c}_b ELSE {c} END"


def m_impute_zero(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(imp.impute_dataframe_zero(_matrix(spark, d)))


def m_range_values(spark: SparkSession, d: str) -> DataFrame:
    most, least, middle = imp.get_range_values_per_column(_matrix(spark, d))
    rows = [(c, most[c], least[c], middle[c]) for c in NUMBERS]
    return spark.createDataFrame(rows, "variable string, greatest double, least double, middle double").withColumn("middle", F.round(F.col("middle") + SHIFT, DIGITS))


def m_per_column_imputer(spark: SparkSession, d: str) -> DataFrame:
    matrix = _matrix(spark, d)
    fitted = pipeline.PerColumnImputer(col_to_NAN_repl_preset={"a__mean": -1.0}).fit(matrix)
    return _scaled(fitted.transform(matrix))


def m_impute_long(spark: SparkSession, d: str) -> DataFrame:
    rows = relevance.melt(_matrix(spark, d).drop("loaded_at").groupBy("id").agg(*[F.max(c).alias(c) for c in NUMBERS]))
    got = imp.impute_long(rows)
    return got.select("id", "variable", F.when(F.abs("value") > 1e20, F.signum("value") * 1e30).otherwise(F.round(F.col("value") + SHIFT, DIGITS) + 0.0).alias("value"))


def r_long_form(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", *WIDE_SORT, *WIDE)
    return to_long(rows, "l_suppkey", WIDE_SORT, validate=False).groupBy("_id", "_kind").agg(F.count("_v").alias("n"), (F.round(F.sum("_v") + SHIFT, 2)).alias("total")).withColumnsRenamed({"_id": "id", "_kind": "kind"})


def r_restrict_to_index(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return imp.restrict_input_to_index(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", rich)


def r_ids(spark: SparkSession, d: str) -> DataFrame:
    return imp.get_ids(table(spark, d, "events"), "user_id")


# --- selection --------------------------------------------------------------------------------------------------------

CHOSEN = {"mean": None, "maximum": None, "length": None, "median": None, "has_duplicate_max": None, "large_standard_deviation": [{"r": 0.295}]}


def _supplier_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", *WIDE_SORT, *WIDE[:2])
    got = extract_features(rows, CHOSEN, column_id="l_suppkey", column_sort=WIDE_SORT, pivot=False, validate=False)
    return got.withColumn("value", F.round(F.col("value") + SHIFT, DIGITS))


def _supplier_target(spark: SparkSession, d: str, kind: str) -> DataFrame:
    s = table(spark, d, "supplier")
    if kind == "real":
        return s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("y"))
    if kind == "binary":
        return s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 4500).cast("int").alias("y"))
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), (F.col("s_nationkey") % 3).cast("string")).alias("y"))


_FEATURES_SQL = "f AS (" + " UNION ALL ".join(
    f"SELECT l_suppkey AS id, '{c}__{n}' AS variable, round(CAST({e.format(c=c)} AS DOUBLE) + {SHIFT:.7f}, {DIGITS}) AS value FROM lineitem GROUP BY 1"
    for c in WIDE[:2]
    for n, e in (("mean", "avg({c})"), ("maximum", "max({c})"), ("length", "count(*)"), ("median", "median({c})"), ("has_duplicate_max", "(count(*) FILTER ({c} = m_{c}) >= 2)::INT"), ("large_standard_deviation__r_0.295", "(stddev_pop({c}) > 0.295 * (max({c}) - min({c})))::INT"))
) + ")"
_FEATURES_SQL = "WITH lineitem AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_suppkey) AS m_l_quantity, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS m_l_extendedprice FROM lineitem), ".replace("WITH lineitem AS", "WITH li AS") + _FEATURES_SQL.replace("FROM lineitem", "FROM li")
_CLASS = "y AS (SELECT s_suppkey AS id, 'n' || (s_nationkey % 3) AS label, s_acctbal AS y FROM supplier), j AS (SELECT f.*, y.label, y.y FROM f JOIN y USING (id))"
_KINDS = "k AS (SELECT variable, CASE count(DISTINCT value) WHEN 1 THEN 'constant' WHEN 2 THEN 'binary' ELSE 'real' END AS type FROM f GROUP BY 1)"


def t_feature_types(spark: SparkSession, d: str) -> DataFrame:
    return relevance.feature_types(_supplier_features(spark, d))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return relevance.value_counts(_supplier_features(spark, d), _supplier_target(spark, d, "class"))


def t_rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    return relevance.rank_statistics(_counts(spark, d)).select("label", "variable", "n1", "n2", "u", "ties")


RANK_SQL = f"""{_FEATURES_SQL}, {_CLASS}, r AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2 AS mid FROM j),
t AS (SELECT variable, sum(c * c * c - c) AS ties, sum(c) AS m FROM (SELECT variable, value, count(*) AS c FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT label, variable, count(*) AS n1, CAST(max(m) - count(*) AS BIGINT) AS n2, sum(mid) - count(*) * (count(*) + 1) / 2 AS u, CAST(max(ties) AS DOUBLE) AS ties FROM r JOIN t USING (variable) GROUP BY 1, 2"""


def t_distance_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _round(relevance.distance_statistics(_counts(spark, d)), ["label", "variable", "n1", "n2"])


DISTANCE_SQL = f"""{_FEATURES_SQL}, {_CLASS}, l AS (SELECT DISTINCT label FROM y), v AS (SELECT DISTINCT variable, value FROM j),
g AS (SELECT l.label, v.variable, v.value, count(*) FILTER (j.label = l.label AND j.value <= v.value) / nullif(count(*) FILTER (j.label = l.label), 0) AS a,
 count(*) FILTER (j.label <> l.label AND j.value <= v.value) / nullif(count(*) FILTER (j.label <> l.label), 0) AS b, count(*) FILTER (j.label = l.label) AS n1, count(*) FILTER (j.label <> l.label) AS n2 FROM l, v JOIN j ON j.variable = v.variable GROUP BY 1, 2, 3)
SELECT label, variable, max(n1) AS n1, max(n2) AS n2, {_r('max(abs(a - b))')} AS d FROM g GROUP BY 1, 2"""


def t_contingency(spark: SparkSession, d: str) -> DataFrame:
    types = t_feature_types(spark, d).where("type = 'binary'")
    return relevance.contingency(_counts(spark, d).join(types.select("variable"), "variable", "left_semi")).select("label", "variable", *[F.col(c).cast("long").alias(c) for c in "abcd"])


CONTINGENCY_SQL = f"""{_FEATURES_SQL}, {_CLASS}, {_KINDS}, h AS (SELECT j.*, value = max(value) OVER (PARTITION BY variable) AS up FROM j JOIN k USING (variable) WHERE type = 'binary'), l AS (SELECT DISTINCT label FROM y)
SELECT l.label, variable, count(*) FILTER (h.label = l.label AND up) AS a, count(*) FILTER (h.label = l.label AND NOT up) AS b, count(*) FILTER (h.label <> l.label AND up) AS c, count(*) FILTER (h.label <> l.label AND NOT up) AS d FROM h, l GROUP BY 1, 2"""


def t_concordance(spark: SparkSession, d: str) -> DataFrame:
    got = relevance.concordance(_supplier_features(spark, d), _supplier_target(spark, d, "real"))
    return got.select("variable", F.col("n").cast("double").alias("n"), F.col("discordant").cast("double").alias("discordant"), F.col("x0").alias("tied_values"), F.col("y0").alias("tied_targets"), F.col("both").alias("tied_both"))


CONCORDANCE_SQL = f"""{_FEATURES_SQL}, {_CLASS} SELECT a.variable, CAST((SELECT count(*) FROM y) AS DOUBLE) AS n, CAST(count(*) FILTER (a.value < b.value AND a.y > b.y) AS DOUBLE) AS discordant, CAST(count(*) FILTER (a.value = b.value AND a.id < b.id) AS DOUBLE) AS tied_values,
CAST(count(*) FILTER (a.y = b.y AND a.id < b.id) AS DOUBLE) AS tied_targets, CAST(count(*) FILTER (a.y = b.y AND a.value = b.value AND a.id < b.id) AS DOUBLE) AS tied_both FROM j a JOIN j b USING (variable) GROUP BY 1"""


def t_split_distances(spark: SparkSession, d: str) -> DataFrame:
    f = _supplier_features(spark, d)
    types = relevance.feature_types(f).where("type = 'binary'")
    return _round(relevance.split_distances(f.join(types.select("variable"), "variable", "left_semi"), _supplier_target(spark, d, "real")), ["variable", "n1", "n2"])


SPLIT_SQL = f"""{_FEATURES_SQL}, {_CLASS}, {_KINDS}, h AS (SELECT j.*, value = max(value) OVER (PARTITION BY variable) AS up FROM j JOIN k USING (variable) WHERE type = 'binary'),
g AS (SELECT e.variable, e.y, count(*) FILTER (h.up) AS n1, count(*) FILTER (NOT h.up) AS n2, count(*) FILTER (h.up AND h.y <= e.y) AS a, count(*) FILTER (NOT h.up AND h.y <= e.y) AS b FROM (SELECT DISTINCT variable, y FROM h) e JOIN h USING (variable) GROUP BY 1, 2)
SELECT variable, max(n1) AS n1, max(n2) AS n2, {_r('max(abs(a / nullif(n1, 0) - b / nullif(n2, 0)))')} AS d FROM g GROUP BY 1"""

#: p-values for the false discovery queries: a fixed function of the documents' ids.
_P = "((doc_id * 7919) % 1009) / 1009.0"


def _p_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.expr(f"pow({_P}, 3)").alias("p_value"))


def t_false_discoveries_independent(spark: SparkSession, d: str) -> DataFrame:
    return relevance.control_false_discoveries(_p_table(spark, d), 0.1, True).select("doc_id", "relevant")


def t_false_discoveries_dependent(spark: SparkSession, d: str) -> DataFrame:
    return relevance.control_false_discoveries(_p_table(spark, d), 0.3, False, within="source").select("doc_id", "relevant")


def _fdr_sql(level: float, c: str, by: str) -> str:
    return f"""WITH p AS (SELECT doc_id, coalesce(source, '') AS g, pow({_P}, 3) AS p FROM documents), r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + count(*) OVER (PARTITION BY {by}, p) - 1 AS rk, count(*) OVER (PARTITION BY {by}) AS m FROM p),
t AS (SELECT *, max(CASE WHEN p <= rk * {level} / (m * {c}) THEN p END) OVER (PARTITION BY {by}) AS least FROM r) SELECT doc_id, coalesce(p <= least, false) AS relevant FROM t"""


def t_relevance_classes(spark: SparkSession, d: str) -> DataFrame:
    return relevance.calculate_relevance_table(_supplier_features(spark, d), _supplier_target(spark, d, "class"))


def t_relevance_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return relevance.calculate_relevance_table(_supplier_features(spark, d), _supplier_target(spark, d, "class"), multiclass=True)


def t_relevance_binary_smirnov(spark: SparkSession, d: str) -> DataFrame:
    return relevance.calculate_relevance_table(_supplier_features(spark, d), _supplier_target(spark, d, "binary"), test_for_binary_target_real_feature="smir")


def t_relevance_regression(spark: SparkSession, d: str) -> DataFrame:
    return relevance.calculate_relevance_table(_supplier_features(spark, d), _supplier_target(spark, d, "real"))


QUERIES = {
    n: f
    for n, f in list(globals().items())
    if n[:2] in ("x_", "w_", "m_", "r_", "t_") and callable(f)
}

SQL = {
    "x_minimal_long": _minimal_sql("(SELECT user_id AS id, event_type AS kind, value AS v FROM events)"),
    "x_minimal_wide_input": _minimal_sql(WIDE_SQL),
    "x_minimal_mapping_input": _minimal_sql("(" + " UNION ALL ".join(f"SELECT l_suppkey AS id, '{c}' AS kind, {c} AS v FROM lineitem" for c in WIDE[:2]) + ")"),
    "x_matrix": MATRIX_SQL,
    "x_settings_per_kind": f"SELECT id, variable, {_r('x')} AS value FROM (SELECT user_id AS id, 'click__maximum' AS variable, max(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, 'view__length', count(*)::DOUBLE FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, 'view__minimum', min(value) FROM events WHERE event_type = 'view' GROUP BY 1)",
    "x_settings_from_names": f"SELECT id, variable, {_r('x')} AS value FROM (SELECT user_id AS id, 'click__mean' AS variable, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, 'view__quantile__q_0.9', quantile_cont(value, 0.9) FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, 'error__linear_trend__attr_\"slope\"', regr_slope(value, t) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE event_type = 'error') GROUP BY 1)",
    "x_custom_calculator": f"SELECT user_id AS id, event_type || '__span__scale_2.0' AS variable, {_r('2 * (max(value) - min(value))')} AS value FROM events GROUP BY 1, 2",
    "x_stream_windows": "SELECT CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS start, user_id AS id, event_type AS kind, " + ", ".join(f"{_r(f'CAST({e} AS DOUBLE)')} AS {f}" for f, e in (("sum_values", "sum(value)"), ("mean", "avg(value)"), ("length", "count(*)"), ("standard_deviation", "stddev_pop(value)"), ("maximum", "max(value)"), ("minimum", "min(value)"))) + " FROM events GROUP BY 1, 2, 3",
    "w_roll_forward": _roll_sql("least(e.rn, 4) >= 2", "o.rn BETWEEN e.rn - 3 AND e.rn"),
    "w_roll_forward_by_two": _roll_sql("((SELECT max(m) FROM o) - e.rn) % 2 = 0", "o.rn BETWEEN e.rn - 4 AND e.rn"),
    "w_roll_backward": _roll_sql("(e.rn - 1) % 2 = 0 AND least(4, e.m - e.rn + 1) >= 3", "o.rn BETWEEN e.rn AND e.rn + 3"),
    "w_roll_features": f"WITH w AS ({MOVING_ROWS}), u AS (" + " UNION ALL ".join(f"SELECT o_custkey AS customer, o_orderkey AS timeshift, 'price__{f}' AS variable, {f} AS x FROM w" for f in FEATURES) + f") SELECT customer, timeshift, variable, {_r('x')} AS value FROM u",
    "w_moving_features": f"SELECT o_custkey AS customer, o_orderkey AS timeshift, {', '.join(f'{_r(f)} AS {f}' for f in FEATURES)} FROM ({MOVING_ROWS}) WHERE least(rn, 4) >= 2",
    "w_forecasting_frame": FORECAST_SQL,
    "w_sub_series": f"{_NUMBERED} SELECT (rn - 1) // 4 AS chunk, o_custkey AS customer, o_orderkey FROM o",
    "m_impute": f"{_STATS} SELECT id, epoch_us(loaded_at) AS at, {', '.join(_scaled_sql(_IMPUTED.format(c=c), c) for c in NUMBERS)} FROM feature_matrix, s",
    "m_per_column_imputer": f"{_STATS} SELECT id, epoch_us(loaded_at) AS at, {', '.join(_scaled_sql(_IMPUTED.format(c=c).replace('a__mean_c', '-1.0'), c) for c in NUMBERS)} FROM feature_matrix, s",
    "m_impute_zero": f"SELECT id, epoch_us(loaded_at) AS at, {', '.join(_scaled_sql(f'coalesce({_FINITE.format(c=c)}, 0)', c) for c in NUMBERS)} FROM feature_matrix",
    "m_range_values": " UNION ALL ".join(f"SELECT '{c}' AS variable, max({_FINITE.format(c=c)}) AS greatest, min({_FINITE.format(c=c)}) AS least, round(median({_FINITE.format(c=c)}) + {SHIFT:.7f}, {DIGITS}) AS middle FROM feature_matrix" for c in NUMBERS),
    "m_impute_long": "WITH x AS (SELECT id, " + ", ".join(f"max({c}) AS {c}" for c in NUMBERS) + " FROM feature_matrix GROUP BY 1), " + _STATS.replace("WITH ", "").replace("FROM feature_matrix", "FROM x") + " " + " UNION ALL ".join(f"SELECT id, '{c}' AS variable, {_scaled_sql(_IMPUTED.format(c=c), 'value')} FROM x, s" for c in NUMBERS),
    "r_long_form": f"SELECT id, kind, count(v) AS n, round(sum(v) + {SHIFT:.7f}, 2) AS total FROM {WIDE_SQL} GROUP BY 1, 2",
    "r_restrict_to_index": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "r_ids": "SELECT DISTINCT user_id AS id FROM events",
    "t_feature_types": f"{_FEATURES_SQL}, {_KINDS} SELECT variable, type FROM k",
    "t_rank_statistics": RANK_SQL,
    "t_distance_statistics": DISTANCE_SQL,
    "t_contingency": CONTINGENCY_SQL,
    "t_concordance": CONCORDANCE_SQL,
    "t_split_distances": SPLIT_SQL,
    "t_false_discoveries_independent": _fdr_sql(0.1, "1", "1"),
    "t_false_discoveries_dependent": _fdr_sql(0.3, "list_sum(list_transform(range(1, m + 1), lambda i: 1 / i))", "g"),
}
