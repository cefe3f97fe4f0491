"""One query per calculator, on the events table, with its default parameters; SQL with list functions beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import naming, settings
from chronofold.plans.extract import extract_features
from chronofold.util import table

DIGITS = 4
#: Added before rounding, here and in the SQL: values with few decimals would otherwise lie on ties, which the last bit decides.
SHIFT = 0.0000017


def rounded(features: DataFrame) -> DataFrame:
    """Values to DIGITS places; not finite: NULL; no negative zero."""
    v = F.col("value")
    return features.withColumn("value", F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.round(v + SHIFT, DIGITS) + 0.0))


def of_events(spark: SparkSession, d: str, chosen: dict) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    got = extract_features(events, chosen, column_id="user_id", column_sort=["ts", "event_id"], column_kind="event_type", column_value="value", column_time="ts", pivot=False, validate=False)
    return rounded(got)


#: Series as lists: short ones of events, and long, tied, signed ones of the lines of suppliers.
EVENT_LISTS = "SELECT user_id AS id, event_type AS kind, list(value ORDER BY ts, event_id) AS x, list(epoch_us(ts) ORDER BY ts, event_id) AS us FROM events GROUP BY 1, 2"
LINE_LISTS = "SELECT l_suppkey AS id, 'line' AS kind, list(CAST(l_quantity AS DOUBLE) - 25 ORDER BY l_orderkey, l_linenumber, l_quantity) AS x FROM lineitem GROUP BY 1"


def of_lines(spark: SparkSession, d: str, chosen: dict) -> DataFrame:
    """Features of the signed quantities of each supplier's lines, in the order of the lines."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity").cast("double") - 25).alias("line"))
    return rounded(extract_features(lines, chosen, column_id="l_suppkey", column_sort=["l_orderkey", "l_linenumber", "l_quantity"], column_value="line", pivot=False, validate=False))


def _sql(pairs: list[tuple[str, str]], more: str = "", again: str = "", lists: str = EVENT_LISTS) -> str:
    items = ", ".join("{'variable': '" + n.replace("'", "''") + f"', 'value': CAST({e} AS DOUBLE)" + "}" for n, e in pairs)
    return f"""WITH s AS ({lists}),
b AS (SELECT *, len(x) AS n, list_avg(x) AS mu, list_stddev_pop(x) AS sd, list_var_pop(x) AS var, list_min(x) AS lo, list_max(x) AS hi{more} FROM s),
c AS (SELECT *{again} FROM b),
u AS (SELECT id, kind, unnest([{items}]) AS f FROM c)
SELECT id, kind || '__' || f.variable AS variable, CASE WHEN isfinite(f.value) THEN round(f.value + {SHIFT:.7f}, {DIGITS}) + 0.0 END AS value FROM u"""


def total(e: str, lo: str = "1", hi: str = "n") -> str:
    return f"list_sum(list_transform(range({lo}, {hi} + 1), lambda i: {e}))"


def average(e: str, lo: str = "1", hi: str = "n") -> str:
    return f"list_avg(list_transform(range({lo}, {hi} + 1), lambda i: {e}))"


def count(cond: str, lo: str = "1", hi: str = "n") -> str:
    return f"len(list_filter(range({lo}, {hi} + 1), lambda i: {cond}))"


def strike(sign: str) -> str:
    flags = f"array_to_string(list_transform(x, lambda v: CASE WHEN v {sign} mu THEN '1' ELSE '0' END), '')"
    return f"list_max(list_transform(string_split({flags}, '0'), lambda p: length(p)))"


def often(v: str) -> str:
    return f"len(list_filter(x, lambda w: w = {v}))"


def _two_sided(r: str, n: str) -> str:
    """The two-sided p-value of a correlation: the t distribution's tail for whole degrees of freedom is a finite sum of cosines."""
    k = f"({n} - 2)"
    angle = f"atan(abs({r}) / sqrt((1 - {r} + 1e-20) * (1 + {r} + 1e-20)))"
    term = lambda up, low: f"pow(cos({angle}), 2 * j) * list_product(list_transform(range(1, j + 1), lambda m: {up} / {low}))"
    even = f"sin({angle}) * (1 + coalesce(list_sum(list_transform(range(1, {k} // 2), lambda j: {term('(2 * m - 1)', '(2 * m)')})), 0))"
    odd = f"2 / pi() * ({angle} + CASE WHEN {k} > 1 THEN sin({angle}) * cos({angle}) * (1 + coalesce(list_sum(list_transform(range(1, ({k} - 1) // 2), lambda j: {term('(2 * m)', '(2 * m + 1)')})), 0)) ELSE 0 END)"
    return f"CASE WHEN {n} > 2 THEN greatest(0, 1 - CASE WHEN {k} % 2 = 0 THEN {even} ELSE {odd} END) WHEN {n} = 2 THEN CASE WHEN {r} = 0 THEN 1.0 WHEN {r} IS NOT NULL THEN 0.0 END END"


def trend(attr: str, x: str, n: str = "n", y: str = "x[i]", my: str = "mu") -> str:
    """Least squares of y on x(i), in closed form."""
    mx = f"({average(x, '1', n)})"
    cov = f"({total(f'(({x}) - mx) * ({y} - {my})', '1', n)} / {n})".replace("mx", mx)
    vx = f"({total(f'pow(({x}) - mx, 2)', '1', n)} / {n})".replace("mx", mx)
    vy = f"({total(f'pow({y} - {my}, 2)', '1', n)} / {n})"
    slope = f"({cov} / nullif({vx}, 0))"
    r = f"(CASE WHEN {vy} > 0 THEN greatest(-1, least(1, {cov} / nullif(sqrt({vx} * {vy}), 0))) WHEN {vx} > 0 THEN 0 END)"
    if attr == "pvalue":
        return _two_sided(r, n)
    return {"slope": slope, "intercept": f"({my} - {slope} * {mx})", "rvalue": r, "stderr": f"(CASE WHEN {n} > 2 THEN sqrt((1 - pow({r}, 2)) * {vy} / nullif({vx}, 0) / ({n} - 2)) WHEN {vx} > 0 THEN 0 END)"}[attr]


EXPRESSIONS: dict[str, Callable[..., str]] = {
    "variance_larger_than_standard_deviation": lambda: "(var > sqrt(var))::INT",
    "ratio_beyond_r_sigma": lambda r: f"list_avg(list_transform(x, lambda v: (abs(v - mu) > {r} * sd)::INT))",
    "large_standard_deviation": lambda r: f"(sd > {r!r} * (hi - lo))::INT",
    "symmetry_looking": lambda r: f"(abs(mu - list_median(x)) < {r!r} * (hi - lo))::INT",
    "has_duplicate_max": lambda: f"({often('hi')} >= 2)::INT",
    "has_duplicate_min": lambda: f"({often('lo')} >= 2)::INT",
    "has_duplicate": lambda: "(len(list_distinct(x)) <> n)::INT",
    "sum_values": lambda: "list_sum(x)",
    "abs_energy": lambda: total("x[i] * x[i]"),
    "cid_ce": lambda normalize: (f"CASE WHEN sd > 0 THEN sqrt(coalesce({total('pow(x[i + 1] - x[i], 2)', '1', 'n - 1')}, 0)) / sd ELSE 0 END" if normalize else f"sqrt(coalesce({total('pow(x[i + 1] - x[i], 2)', '1', 'n - 1')}, 0))"),
    "mean_abs_change": lambda: average("abs(x[i + 1] - x[i])", "1", "n - 1"),
    "mean_change": lambda: "CASE WHEN n > 1 THEN (x[n] - x[1]) / (n - 1) END",
    "mean_second_derivative_central": lambda: "CASE WHEN n > 2 THEN (x[n] - x[n - 1] - x[2] + x[1]) / (2 * (n - 2)) END",
    "median": lambda: "list_median(x)",
    "mean": lambda: "mu",
    "length": lambda: "n",
    "standard_deviation": lambda: "sd",
    "variation_coefficient": lambda: "sd / nullif(mu, 0)",
    "variance": lambda: "var",
    "skewness": lambda: "CASE WHEN n >= 3 THEN CASE WHEN var > 0 THEN list_skewness(x) ELSE 0 END END",
    "kurtosis": lambda: "CASE WHEN n >= 4 THEN CASE WHEN var > 0 THEN list_kurtosis(x) ELSE 0 END END",
    "root_mean_square": lambda: f"sqrt({average('x[i] * x[i]')})",
    "absolute_sum_of_changes": lambda: f"coalesce({total('abs(x[i + 1] - x[i])', '1', 'n - 1')}, 0)",
    "longest_strike_below_mean": lambda: strike("<"),
    "longest_strike_above_mean": lambda: strike(">"),
    "count_above_mean": lambda: count("x[i] > mu"),
    "count_below_mean": lambda: count("x[i] < mu"),
    "last_location_of_maximum": lambda: "(n - list_position(list_reverse(x), hi) + 1) / n",
    "first_location_of_maximum": lambda: "(list_position(x, hi) - 1) / n",
    "last_location_of_minimum": lambda: "(n - list_position(list_reverse(x), lo) + 1) / n",
    "first_location_of_minimum": lambda: "(list_position(x, lo) - 1) / n",
    "percentage_of_reoccurring_values_to_all_values": lambda: f"len(list_filter(list_distinct(x), lambda v: {often('v')} > 1)) / len(list_distinct(x))",
    "percentage_of_reoccurring_datapoints_to_all_datapoints": lambda: f"len(list_filter(x, lambda v: {often('v')} > 1)) / n",
    "sum_of_reoccurring_values": lambda: f"coalesce(list_sum(list_filter(list_distinct(x), lambda v: {often('v')} > 1)), 0)",
    "sum_of_reoccurring_data_points": lambda: f"coalesce(list_sum(list_filter(x, lambda v: {often('v')} > 1)), 0)",
    "ratio_value_number_to_time_series_length": lambda: "len(list_distinct(x)) / n",
    "number_peaks": lambda n: count(f"x[i] > list_max(x[i - {n} : i - 1]) AND x[i] > list_max(x[i + 1 : i + {n}])", str(n + 1), f"n - {n}"),
    "index_mass_quantile": lambda q: f"list_min(list_filter(range(1, n + 1), lambda i: list_sum(list_transform(x[1 : i], lambda v: abs(v))) / nullif(list_sum(list_transform(x, lambda v: abs(v))), 0) >= {q})) / n",
    "linear_trend": lambda attr: trend(attr, "i - 1"),
    "linear_trend_timewise": lambda attr: trend(attr, "(us[i] - us[1]) / 3.6e9"),
    "change_quantiles": lambda ql, qh, isabs, f_agg: f"coalesce(list_{ {'mean': 'avg', 'var': 'var_pop'}[f_agg]}(list_transform(list_filter(range(1, n), lambda i: x[i] BETWEEN list_aggregate(x, 'quantile_cont', {ql}) AND list_aggregate(x, 'quantile_cont', {qh}) AND x[i + 1] BETWEEN list_aggregate(x, 'quantile_cont', {ql}) AND list_aggregate(x, 'quantile_cont', {qh})), lambda i: {'abs' if isabs else ''}(x[i + 1] - x[i]))), 0)",
    "time_reversal_asymmetry_statistic": lambda lag: f"coalesce({average(f'x[i + {2 * lag}] * x[i + {2 * lag}] * x[i + {lag}] - x[i + {lag}] * x[i] * x[i]', '1', f'n - {2 * lag}')}, 0)",
    "c3": lambda lag: f"coalesce({average(f'x[i + {2 * lag}] * x[i + {lag}] * x[i]', '1', f'n - {2 * lag}')}, 0)",
    "mean_n_absolute_max": lambda number_of_maxima: f"CASE WHEN n > {number_of_maxima} THEN list_avg(list_reverse_sort(list_transform(x, lambda v: abs(v)))[1 : {number_of_maxima}]) END",
    "autocorrelation": lambda lag: f"CASE WHEN n > {lag} AND var > 1e-16 THEN {total(f'(x[i] - mu) * (x[i + {lag}] - mu)', '1', f'n - {lag}')} / ((n - {lag}) * var) END",
    "quantile": lambda q: f"list_aggregate(x, 'quantile_cont', {q})",
    "number_crossing_m": lambda m: count(f"(x[i] > {m}) <> (x[i + 1] > {m})", "1", "n - 1"),
    "maximum": lambda: "hi",
    "absolute_maximum": lambda: "greatest(abs(hi), abs(lo))",
    "minimum": lambda: "lo",
    "value_count": lambda value: count(f"x[i] = {value}"),
    "range_count": lambda min, max: count(f"x[i] >= {min} AND x[i] < {max}"),  # noqa: A006
    "count_above": lambda t: f"{count(f'x[i] >= {t}')} / n",
    "count_below": lambda t: f"{count(f'x[i] <= {t}')} / n",
    "energy_ratio_by_chunks": lambda num_segments, segment_focus: f"coalesce({total('x[i] * x[i]', f'({segment_focus} * (n // {num_segments}) + least({segment_focus}, n % {num_segments}) + 1)', f'({segment_focus + 1} * (n // {num_segments}) + least({segment_focus + 1}, n % {num_segments}))')}, 0) / nullif({total('x[i] * x[i]')}, 0)",
}


def _fft(attr: str, coeff: int) -> str:
    re = total(f"x[i] * cos(2 * pi() * {coeff} * (i - 1) / n)")
    im = f"(-{total(f'x[i] * sin(2 * pi() * {coeff} * (i - 1) / n)')})"
    value = {"real": re, "imag": im, "abs": f"sqrt(pow({re}, 2) + pow({im}, 2))", "angle": f"degrees(atan2(round({im}, 8) + 0.0, {re}))"}[attr]
    return f"CASE WHEN {coeff} <= n // 2 THEN {value} END"


#: Spectra, entropies and the like need a column of lists first: (columns, expressions over them).
_AMPLITUDES = ", list_transform(range(0, n // 2 + 1), lambda k: sqrt(pow(list_sum(list_transform(range(1, n + 1), lambda i: x[i] * cos(2 * pi() * k * (i - 1) / n))), 2) + pow(list_sum(list_transform(range(1, n + 1), lambda i: x[i] * sin(2 * pi() * k * (i - 1) / n))), 2))) AS a"


def _moment(k: int) -> str:
    return f"(list_sum(list_transform(range(1, len(a) + 1), lambda i: pow(i - 1, {k}) * a[i])) / list_sum(a))"


def _window(e: str) -> str:
    return f"list_sum(list_transform(range(1, n + 1), lambda i: (x[i] - mu) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / n)) * {e}(2 * pi() * k * (i - 1) / n)))"


_POWER = f", list_transform(range(0, n // 2 + 1), lambda k: (pow({_window('cos')}, 2) + pow({_window('sin')}, 2)) / nullif(list_sum(list_transform(range(1, n + 1), lambda i: pow(0.5 - 0.5 * cos(2 * pi() * (i - 1) / n), 2))), 0) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END) AS p"


def _near(i: str, j: str, m: int, tolerance: str) -> str:
    return " AND ".join(f"abs(x[{i} + {k}] - x[{j} + {k}]) <= {tolerance}" for k in range(m))


def _pairs(m: int, templates: str) -> str:
    return f"list_sum(list_transform(range(1, {templates} + 1), lambda i: len(list_filter(range(1, {templates} + 1), lambda j: i <> j AND {_near('i', 'j', m, '0.2 * sd')}))))"


def _phi(m: int, r: float) -> str:
    t = f"(n - {m} + 1)"
    return f"(list_sum(list_transform(range(1, {t} + 1), lambda i: ln(len(list_filter(range(1, {t} + 1), lambda j: {_near('i', 'j', m, f'{r} * sd')})) / {t}))) / {t})"


def _entropy(items: str, length: str) -> str:
    return f"(-list_sum(list_transform(list_distinct({items}), lambda d: (len(list_filter({items}, lambda e: e = d)) / {length}) * ln(len(list_filter({items}, lambda e: e = d)) / {length}))) + 0.0)"


def _digit_share(d: int) -> str:
    return f"(len(list_filter(x, lambda v: regexp_extract(CAST(abs(v) AS VARCHAR), '[1-9]') = '{d}')) / n)"


def _special(name: str) -> str | None:
    sets = settings.comprehensive()[name]
    named = [(naming.feature_name(name, p), p) for p in sets or [None]]
    if name == "fft_coefficient":
        return _sql([(n, _fft(**p)) for n, p in named])
    if name == "fft_aggregated":
        v = f"({_moment(2)} - pow({_moment(1)}, 2))"
        values = {
            "centroid": _moment(1),
            "variance": v,
            "skew": f"CASE WHEN {v} >= 0.5 THEN ({_moment(3)} - 3 * {_moment(1)} * {v} - pow({_moment(1)}, 3)) / pow({v}, 1.5) END",
            "kurtosis": f"CASE WHEN {v} >= 0.5 THEN ({_moment(4)} - 4 * {_moment(1)} * {_moment(3)} + 6 * {_moment(2)} * pow({_moment(1)}, 2) - 3 * {_moment(1)}) / pow({v}, 2) END",
        }
        return _sql([(n, values[p["aggtype"]]) for n, p in named], again=_AMPLITUDES)
    if name == "spkt_welch_density":
        # One window: the series of the test tables are shorter than 256 points.
        return _sql([(n, f"p[{p['coeff']} + 1]") for n, p in named], again=_POWER)
    if name == "agg_autocorrelation":
        acf = ", list_transform(range(1, least(40, n - 1) + 1), lambda l: list_sum(list_transform(range(1, n - l + 1), lambda i: (x[i] - mu) * (x[i + l] - mu))) / ((n - l) * nullif(var, 0))) AS acf"
        return _sql([(n, f"list_{ {'mean': 'avg', 'median': 'median', 'var': 'var_pop'}[p['f_agg']]}(acf)") for n, p in named], again=acf)
    if name == "binned_entropy":
        place = ", list_transform(x, lambda v: CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 0 END) AS bins"
        return _sql([(n, _entropy("bins", "n")) for n, _ in named], again=place)
    if name == "permutation_entropy":
        cols = "".join(f", list_transform(range(1, n - {p['dimension']} + 2), lambda i: list_grade_up(x[i : i + {p['dimension'] - 1}])::VARCHAR) AS o{p['dimension']}" for _, p in named)
        return _sql([(n, f"CASE WHEN n >= {p['dimension']} THEN {_entropy('o%d' % p['dimension'], 'len(o%d)' % p['dimension'])} END") for n, p in named], again=cols)
    if name == "sample_entropy":
        return _sql([(n, "CASE WHEN n >= 3 AND aa > 0 AND bb > 0 THEN -ln(aa / bb) END") for n, _ in named], again=f", {_pairs(2, '(n - 1)')} AS bb, {_pairs(3, '(n - 2)')} AS aa")
    if name == "approximate_entropy":
        return _sql([(n, f"CASE WHEN n <= {p['m'] + 1} THEN 0 ELSE abs({_phi(p['m'], p['r'])} - {_phi(p['m'] + 1, p['r'])}) END") for n, p in named])
    if name == "benford_correlation":
        cols = ", [" + ", ".join(_digit_share(k) for k in range(1, 10)) + "] AS f, [" + ", ".join(f"log10(1 + 1 / {k})" for k in range(1, 10)) + "] AS law"
        r = "list_sum(list_transform(range(1, 10), lambda i: (f[i] - list_avg(f)) * (law[i] - list_avg(law)))) / nullif(sqrt(list_sum(list_transform(range(1, 10), lambda i: pow(f[i] - list_avg(f), 2))) * list_sum(list_transform(range(1, 10), lambda i: pow(law[i] - list_avg(law), 2)))), 0)"
        return _sql([(n, r) for n, _ in named], again=cols).replace("AS f, [", "AS fr, [").replace("f[i]", "fr[i]").replace("list_avg(f)", "list_avg(fr)")
    if name == "agg_linear_trend":
        cols = "".join(
            f", list_transform(range(0, (n - 1) // {c} + 1), lambda k: list_{f2}(x[k * {c} + 1 : least(n, k * {c} + {c})])) AS c{c}{f}" for c in (5, 10, 50) for f, f2 in (("max", "max"), ("min", "min"), ("mean", "avg"), ("var", "var_pop"))
        )

        def one(attr: str, chunk_len: int, f_agg: str) -> str:
            y = f"c{chunk_len}{f_agg}"
            return f"CASE WHEN n > {chunk_len} THEN {trend(attr, 'i - 1', f'len({y})', f'{y}[i]', f'list_avg({y})')} END"

        return _sql([(n, one(**p)) for n, p in named], again=cols)
    if name == "query_similarity_count":
        return _sql([(naming.feature_name(name, p), _similar(**p)) for p in SIMILAR])
    if name == "fourier_entropy":
        scaled = _POWER + ", list_transform(p, lambda v: v / nullif(list_max(p), 0)) AS r"
        return _sql([(n, f"CASE WHEN list_max(p) > 0 THEN {_entropy(_bins('r', p['bins']), 'len(r)')} END") for n, p in named], again=scaled)
    return None


#: The default asks for no query, which has no result; so the query asks for one with a rise and a fall, with and without normalising.
SIMILAR = [{"query": [1.0, 4.0, 2.0], "threshold": t, "normalize": z} for z, t in ((True, 0.5), (True, 1.5), (False, 40.0))]


def _similar(query: list[float], threshold: float, normalize: bool) -> str:
    m = len(query)
    at = [f"x[i + {k}]" for k in range(m)]
    if normalize:
        mean, center = f"(({' + '.join(at)}) / {m})", sum(query) / m
        sd = f"sqrt(({' + '.join(f'pow({a} - {mean}, 2)' for a in at)}) / {m})"
        spread = (sum((q - center) ** 2 for q in query) / m) ** 0.5
        at, query = [f"(CASE WHEN {sd} > 1e-12 THEN ({a} - {mean}) / {sd} ELSE 0 END)" for a in at], [(q - center) / spread for q in query]
    far = " + ".join(f"pow({a} - {q!r}, 2)" for a, q in zip(at, query))
    return f"CASE WHEN n >= {m} THEN {count(f'sqrt({far}) <= {threshold}', '1', f'n - {m - 1}')} END"


def _bins(items: str, bins: int) -> str:
    low, high = f"list_min({items})", f"list_max({items})"
    return f"list_transform({items}, lambda v: CASE WHEN {high} > {low} THEN least(floor((v - {low}) / ({high} - {low}) * {bins}), {bins - 1}) ELSE 0 END)"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    chosen = SIMILAR if name == "query_similarity_count" else settings.comprehensive()[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return of_events(spark, d, {name: chosen})

    return run


def _oracle(name: str) -> str | None:
    if name in EXPRESSIONS:
        sets = settings.comprehensive()[name] or [None]
        return _sql([(naming.feature_name(name, p), EXPRESSIONS[name](**(p or {}))) for p in sets])
    return _special(name)


#: Calculators that are also tested on long series: those whose SQL is linear in the length.
LONG = ["ratio_beyond_r_sigma", "large_standard_deviation", "symmetry_looking", "cid_ce", "mean_abs_change", "mean_change", "mean_second_derivative_central", "variance", "skewness", "kurtosis", "root_mean_square", "absolute_sum_of_changes", "longest_strike_below_mean", "longest_strike_above_mean", "count_above_mean", "count_below_mean", "last_location_of_maximum", "first_location_of_maximum", "last_location_of_minimum", "first_location_of_minimum", "time_reversal_asymmetry_statistic", "c3", "mean_n_absolute_max", "autocorrelation", "quantile", "number_crossing_m", "value_count", "range_count", "count_above", "count_below", "energy_ratio_by_chunks"]
LONG_CHANGES = {"change_quantiles": [{"ql": a, "qh": b, "isabs": z, "f_agg": f} for a, b in ((0.2, 0.8),) for z in (False, True) for f in ("mean", "var")], "number_peaks": [{"n": n} for n in (1, 3, 5, 10, 50)]}
LONG_SPECTRA = {"fft_coefficient": [{"coeff": k, "attr": a} for k in (0, 1, 7, 50, 99) for a in ("real", "imag", "abs")], "index_mass_quantile": [{"q": q} for q in (0.1, 0.5, 0.9)]}


def _long_sets(names: list[str]) -> dict:
    return {n: settings.comprehensive()[n] for n in names}


def _long_sql(chosen: dict) -> str:
    one = lambda n, p: _fft(**p) if n == "fft_coefficient" else EXPRESSIONS[n](**(p or {}))
    return _sql([(naming.feature_name(n, p), one(n, p)) for n, sets in chosen.items() for p in sets or [None]], lists=LINE_LISTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _i, _name in enumerate(settings.NAMES):
    QUERIES[f"f_{_name}"] = _query(_name)
    if (_text := _oracle(_name)) is not None:
        SQL[f"f_{_name}"] = _text
for _name, _chosen in {"x_long_statistics": _long_sets(LONG), "x_long_changes": LONG_CHANGES, "x_long_spectra": LONG_SPECTRA}.items():
    QUERIES[_name] = lambda spark, d, chosen=_chosen: of_lines(spark, d, chosen)
    SQL[_name] = _long_sql(_chosen)
