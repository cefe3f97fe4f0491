"""SQL of the record queries that SQL can express."""

_CELL = "lower(regexp_replace(value, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'))"
_NUM = "regexp_full_match(r, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)(e[+-]?[0-9]+)?')"
_TYPED = f"""c AS (SELECT column_id, variable, dtype, loaded_at, {_CELL} AS r FROM feature_rows JOIN feature_names USING (variable) WHERE column_id IS NOT NULL),
n AS (SELECT *, CASE WHEN {_NUM} THEN TRY_CAST(replace(r, ',', '.') AS DOUBLE) END AS num, r IS NULL OR r IN ('', 'nan', 'na', 'null', 'none') AS gone FROM c),
t AS (SELECT *, CASE WHEN gone THEN NULL
 WHEN dtype = 'double' THEN CASE WHEN num IS NOT NULL THEN num + 0.0 WHEN regexp_full_match(r, '[+-]?inf(inity)?') THEN CASE WHEN r LIKE '-%' THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END END
 WHEN dtype = 'bigint' THEN CASE WHEN num = floor(num) THEN num END
 ELSE CASE WHEN r IN ('true', 't', 'yes', 'y') OR num = 1 THEN 1 WHEN r IN ('false', 'f', 'no', 'n') OR num = 0 THEN 0 END END AS typed FROM n),
g AS (SELECT column_id, variable, any_value(dtype) AS dtype, max(struct_pack(a := loaded_at, v := typed)) FILTER (typed IS NOT NULL) AS last, min(typed) AS least, max(typed) AS most, bool_or(NOT gone AND typed IS NULL) AS odd FROM t GROUP BY 1, 2)"""

_PAIRS = "(SELECT id, kind, sort, min(CASE WHEN NOT isnan(value) THEN value END) AS v FROM series_long WHERE id IS NOT NULL AND kind IS NOT NULL GROUP BY 1, 2, 3)"

_DAYS = """r AS (SELECT DISTINCT symbols, date, CAST(high AS DECIMAL(18,2)) AS high FROM df_melted WHERE symbols IS NOT NULL AND date IS NOT NULL AND high IS NOT NULL AND NOT isnan(high)),
d AS (SELECT symbols, CAST(floor(epoch(date) / 86400) AS INT) AS day, sum(high) AS t, count(*) AS n FROM r GROUP BY 1, 2), e AS (SELECT symbols, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
k AS (SELECT symbols, a, unnest(range(a, b + 1)) AS day FROM e),
w AS (SELECT symbols, k.a, k.day, coalesce(sum(t) OVER s7, 0) AS t7, coalesce(sum(n) OVER s7, 0) AS n7, coalesce(sum(t) OVER s30, 0) AS t30, coalesce(sum(n) OVER s30, 0) AS n30 FROM k LEFT JOIN d USING (symbols, day)
 WINDOW s7 AS (PARTITION BY symbols ORDER BY k.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), s30 AS (PARTITION BY symbols ORDER BY k.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
_DAY = "strftime(CAST('1970-01-01' AS DATE) + CAST(day AS INTEGER), '%Y-%m-%d')"

_NUMBERS = ["a__mean", "a__standard_deviation", "a__maximum", "b__median", "b__abs_energy", "b__mean_change"]
_THERE = {c: f"(isfinite({c}) AND {c} NOT IN (-9999, -999, -99999, -999999, 1e30, -1e30, 1e20, -1e20))" for c in _NUMBERS} | {
    c: f"(lower(trim({c})) NOT IN ('', '-', '--', '---', '?', '??', '.', 'n/a', '#n/a', 'na', 'n.a.', 'nan', 'null', '(null)', 'nil', 'none', 'unknown', 'missing', 'undefined', 'unspecified', 'not available', 'tbd'))" for c in ("regime", "y_label")
}

#: The variables of the test tables, for each of three kinds of series.
_VARIABLES = {
    "bigint": ("count_above_mean", "length", "longest_strike_below_mean", "number_crossing_m__m_0", "number_peaks__n_3", "range_count__max_1__min_-1"),
    "boolean": ("has_duplicate", "has_duplicate_max", "large_standard_deviation__r_0.25", "symmetry_looking__r_0.1", "variance_larger_than_standard_deviation"),
    "double": ("abs_energy", "c3__lag_2", 'fft_coefficient__attr_"real"__coeff_1', 'linear_trend__attr_"slope"', "maximum", "mean", "median", "quantile__q_0.9", "standard_deviation"),
}
_AS = {"bigint": "max(TRY_CAST(v AS BIGINT))", "boolean": "bool_or(v = 1)", "double": "max(v)"}

SQL = {
    "p1_found": "SELECT id, kind FROM series_long GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM series_long) AND id IS NOT NULL AND kind IS NOT NULL",
    "p1_profile": f"""WITH r AS {_PAIRS}, v AS (SELECT *, lag(v) OVER (PARTITION BY id, kind ORDER BY sort) AS p FROM r WHERE v IS NOT NULL)
SELECT id, kind, (SELECT count(*) FROM r WHERE r.id = g.id AND r.kind = g.kind) AS n_rows, n_values, mean, std, minimum, maximum, first_value, last_value, mean_change, absolute_sum_of_changes, number_crossing_zero FROM (
SELECT id, kind, count(*) AS n_values, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS minimum, round(max(v), 4) AS maximum, round(arg_min(v, sort), 4) AS first_value, round(arg_max(v, sort), 4) AS last_value,
round(CASE WHEN count(*) > 1 THEN (arg_max(v, sort) - arg_min(v, sort)) / (count(*) - 1) END, 4) AS mean_change, round(coalesce(sum(abs(v - p)), 0), 4) AS absolute_sum_of_changes, count(*) FILTER ((v > 0) <> (p > 0)) AS number_crossing_zero FROM v GROUP BY 1, 2) g""",
    "p2_found": f"WITH {_DAYS} SELECT symbols, {_DAY} AS day FROM w WHERE day >= a + 29 AND 2 * t7 > t30",
    "p2_trailing": f"WITH {_DAYS} SELECT symbols, {_DAY} AS day, CAST(t7 AS DOUBLE) AS total_7, round(CAST(t7 AS DOUBLE) / nullif(n7, 0) + 0.0000017, 4) AS average_7, CAST(t30 AS DOUBLE) AS total_30, round(CAST(t30 AS DOUBLE) / nullif(n30, 0) + 0.0000017, 4) AS average_30 FROM w",
    "p3_found": f"WITH {_TYPED} SELECT column_id, variable, CASE WHEN least <> most THEN 'conflict' ELSE 'unreadable' END AS issue FROM g WHERE least <> most OR (least IS NULL AND odd)",
    "p3_wide": f"WITH {_TYPED} SELECT column_id, " + ", ".join(f'{_AS[t]} FILTER (variable = \'{k}__{n}\') AS "{(k + "__" + n).replace(chr(34), chr(34) * 2)}"' for k in ("a", "b", "f_x") for t, names in _VARIABLES.items() for n in names) + " FROM (SELECT column_id, variable, last.v AS v FROM g UNION ALL SELECT DISTINCT column_id, NULL, NULL FROM feature_rows WHERE column_id IS NOT NULL) GROUP BY 1",
    "p4_found": "WITH m AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM feature_matrix WHERE grp IS NOT NULL) " + " UNION ALL ".join(
        f"SELECT id, '{c}' AS variable FROM (SELECT id, coalesce({t}, false) AS here, bool_or(coalesce({t}, false)) OVER (PARTITION BY grp) AS other FROM m) WHERE NOT here AND other" for c, t in _THERE.items()
    ),
    "p6_found": """WITH r AS (SELECT id, step_s, CAST(floor(epoch_us(time) / (step_s::BIGINT * 1000000)) AS BIGINT) AS k FROM sensor_readings JOIN sensors USING (id) WHERE time IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
e AS (SELECT id, step_s, unnest(range(min(k), max(k) + 1)) AS k FROM r GROUP BY 1, 2) SELECT id, k * step_s AS slot_epoch FROM e ANTI JOIN r USING (id, k)""",
    "p6_grid": """WITH u AS (SELECT DISTINCT reading_id, id, epoch_us(time) AS t, value AS v, step_s::BIGINT AS s FROM sensor_readings JOIN sensors USING (id) WHERE time IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT *, CAST(floor(t / (s * 1000000)) AS BIGINT) AS k FROM u), e AS (SELECT id, s, unnest(range(min(k), max(k) + 1)) AS k FROM r GROUP BY 1, 2),
j AS (SELECT e.id, e.s, e.k, r.k AS rk, (r.t - (e.k + 0.5) * e.s * 1000000) / (e.s * 1000000) AS x, r.v FROM e JOIN r ON r.id = e.id AND r.k BETWEEN e.k - 2 AND e.k + 2),
w AS (SELECT *, CASE WHEN abs(x / 2.5) < 1 THEN 0.75 * (1 - (x / 2.5) * (x / 2.5)) ELSE 0 END AS w FROM j),
m AS (SELECT id, k, count(*) FILTER (rk = k) AS n, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * v) AS t0, sum(w * x * v) AS t1, sum(w * w) AS ww FROM w GROUP BY 1, 2),
g AS (SELECT e.id, e.k * e.s AS slot_epoch, coalesce(n, 0) AS n_readings, coalesce(s0 * s0 / nullif(ww, 0), 0) AS support, s0, s1, s2, t0, t1 FROM e LEFT JOIN m USING (id, k))
SELECT id, slot_epoch, round(CASE WHEN support >= 1.5 AND s2 / s0 - pow(s1 / s0, 2) > 1e-3 THEN (s2 * t0 - s1 * t1) / nullif(s0 * s2 - s1 * s1, 0) WHEN support >= 1.5 OR n_readings > 0 THEN t0 / nullif(s0, 0) END + 0.0000017, 4) AS value, n_readings, round(support + 0.0000017, 4) AS support,
CASE WHEN n_readings > 0 THEN 'observed' WHEN support >= 1.5 THEN 'filled' ELSE 'missing' END AS status FROM g""",
}


def _flagged() -> str:
    """The cases of the statement as plain SQL: outside the limits, short excursions, stuck runs."""
    near = ", ".join(f"lag(v, {k}) OVER w AS b{k}, lead(v, {k}) OVER w AS a{k}" for k in (1, 2, 3))
    at = lambda k: "v" if k == 0 else f"a{k}" if k > 0 else f"b{-k}"
    cases = []
    for length in (1, 2, 3):
        for j in range(length):
            p, q, block = at(-j - 1), at(length - j), [at(i) for i in range(-j, length - j)]
            far = "least(" + ", ".join(f"abs({b} - {p}), abs({b} - {q})" for b in block) + ")"
            above, below = (" AND ".join(f"{b} {s} {p} AND {b} {s} {q}" for b in block) for s in "><")
            cases.append(f"(({above}) OR ({below})) AND {far} > 2 * abs({q} - {p}) AND {far} >= 9 * usual")
    return f"""WITH u AS (SELECT DISTINCT reading_id, id, time, value AS v FROM sensor_readings WHERE time IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
o AS (SELECT *, {near} FROM u WINDOW w AS (PARTITION BY id ORDER BY time, reading_id)),
r AS (SELECT *, sum(CASE WHEN b1 IS NULL OR v <> b1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY time, reading_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
c AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS n FROM r),
f AS (SELECT id, quantile_disc(abs(v - b1), 0.5) FILTER (v <> b1) AS usual, count(*) FILTER (n > 1 AND (b1 IS NULL OR v <> b1)) / count(*) FILTER (b1 IS NULL OR v <> b1) AS again FROM c GROUP BY 1)
SELECT reading_id FROM c JOIN f USING (id) LEFT JOIN sensors USING (id) WHERE v < lo OR v > hi OR (n >= 10 AND again <= 0.15) OR {" OR ".join(f"({x})" for x in cases)}"""


SQL["p5_found"] = _flagged()
