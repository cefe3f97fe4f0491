"""Calculators as Spark expressions.

A feature is built in up to three places, all of which share one shuffle on (id, kind): columns on the rows (window functions), aggregates of
the group, and an expression over the aggregates. ``Build`` collects what the requested features need; equal pieces are built
once. A result that is not defined is NULL; truth values are 0.0 and 1.0.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window, WindowSpec

from chronofold.functions import kernels

KEYS = ["_id", "_kind"]
V, T, S = "_v", "_t", "_s"
NATIVE: dict[str, Callable[..., Column]] = {}


def native(f: Callable[..., Column]) -> Callable[..., Column]:
    NATIVE[f.__name__] = f
    return f


def _plain(name: str) -> str:
    """Numbers in names of columns without points and signs."""
    return name.replace(".", "p").replace("-", "m").replace("+", "")


class Build:
    """The row columns (in levels, each of which may use those before) and aggregates that the requested features need."""

    def __init__(self) -> None:
        self.levels: list[dict[str, Column]] = [{}, {}, {}, {}]
        self.aggs: dict[str, Column] = {}
        self.v = F.col(V)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*KEYS).orderBy(S)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*KEYS)

    def row(self, level: int, name: str, make: Callable[[], Column]) -> Column:
        name = _plain(name)
        if name not in self.levels[level]:
            self.levels[level][name] = make()
        return F.col(name)

    def agg(self, name: str, make: Callable[[], Column]) -> Column:
        name = _plain(name)
        if name not in self.aggs:
            self.aggs[name] = make()
        return F.col(name)

    # rows
    def t(self) -> Column:
        return self.row(0, T, lambda: (F.row_number().over(self.ordered) - 1).cast("double"))

    def shifted(self, k: int) -> Column:
        """The value k places later (earlier, if k is negative)."""
        return self.v if k == 0 else self.row(0, f"_at{k}", lambda: F.lead(V, k).over(self.ordered))

    def of_group(self, name: str, f: Callable[[str], Column]) -> Column:
        return self.row(0, f"_g_{name}", lambda: f(V).over(self.whole))

    def mean_row(self) -> Column:
        return self.of_group("mean", F.avg)

    def count_row(self) -> Column:
        return self.of_group("n", F.count)

    def same(self) -> Column:
        """How many points of the series have this value."""
        return self.row(0, "_same", lambda: F.count(F.lit(1)).over(Window.partitionBy(*KEYS, V)))

    def first_of_value(self) -> Column:
        return self.row(0, "_first", lambda: F.row_number().over(Window.partitionBy(*KEYS, V).orderBy(S)) == 1)

    # aggregates
    def n(self) -> Column:
        return self.agg("n", lambda: F.count(V).cast("double"))

    def mean(self) -> Column:
        return self.agg("mean", lambda: F.avg(V))

    def var(self) -> Column:
        return self.agg("var", lambda: F.var_pop(V))

    def sd(self) -> Column:
        return self.agg("sd", lambda: F.stddev_pop(V))

    def low(self) -> Column:
        return self.agg("low", lambda: F.min(V))

    def high(self) -> Column:
        return self.agg("high", lambda: F.max(V))

    def squares(self) -> Column:
        return self.agg("squares", lambda: F.sum(self.v * self.v))

    def series(self) -> Column:
        """The values in order, as an array."""
        self.t()
        return self.agg("series", lambda: F.transform(F.sort_array(F.collect_list(F.struct(T, V))), lambda p: p[V]))

    def times(self) -> Column:
        """The times in the order of the values, in microseconds."""
        self.t()
        return self.agg("times", lambda: F.transform(F.sort_array(F.collect_list(F.struct(F.col(T), F.unix_micros("_ts").alias("u")))), lambda p: p["u"]))


def truth(c: Column) -> Column:
    return c.cast("double")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# --- moments, extremes, counts ----------------------------------------------------------------------------------------


@native
def variance_larger_than_standard_deviation(b):
    return truth(b.var() > F.sqrt(b.var()))


@native
def ratio_beyond_r_sigma(b, r):
    mean, sd = b.mean_row(), b.of_group("sd", F.stddev_pop)
    return b.agg(f"beyond_{r}", lambda: F.avg(truth(F.abs(b.v - mean) > r * sd)))


@native
def large_standard_deviation(b, r):
    return truth(b.sd() > r * (b.high() - b.low()))


@native
def symmetry_looking(b, r):
    return truth(F.abs(b.mean() - median(b)) < r * (b.high() - b.low()))


@native
def has_duplicate_max(b):
    top = b.of_group("max", F.max)
    return truth(b.agg("tops", lambda: F.count_if(b.v == top)) >= 2)


@native
def has_duplicate_min(b):
    low = b.of_group("min", F.min)
    return truth(b.agg("lows", lambda: F.count_if(b.v == low)) >= 2)


@native
def has_duplicate(b):
    same = b.same()
    return truth(b.agg("most_same", lambda: F.max(same)) > 1)


@native
def sum_values(b):
    return b.agg("total", lambda: zero(F.sum(V)))


@native
def abs_energy(b):
    return b.squares()


@native
def median(b):
    return b.agg("median", lambda: F.median(V))


@native
def mean(b):
    return b.mean()


@native
def length(b):
    return b.n()


@native
def standard_deviation(b):
    return b.sd()


@native
def variation_coefficient(b):
    return F.try_divide(b.sd(), b.mean())


@native
def variance(b):
    return b.var()


@native
def skewness(b):
    n, g = b.n(), b.agg("skew", lambda: F.skewness(V))
    return F.when(n >= 3, F.when(b.var() > 0, F.sqrt(n * (n - 1)) / (n - 2) * g).otherwise(0.0))


@native
def kurtosis(b):
    n, g = b.n(), b.agg("kurt", lambda: F.kurtosis(V))
    return F.when(n >= 4, F.when(b.var() > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)).otherwise(0.0))


@native
def root_mean_square(b):
    return F.sqrt(b.squares() / b.n())


@native
def maximum(b):
    return b.high()


@native
def minimum(b):
    return b.low()


@native
def absolute_maximum(b):
    return F.greatest(F.abs(b.high()), F.abs(b.low()))


@native
def quantile(b, q):
    return b.agg(f"q_{q}", lambda: F.percentile(V, q))


@native
def count_above_mean(b):
    mean = b.mean_row()
    return truth(b.agg("above_mean", lambda: F.count_if(b.v > mean)))


@native
def count_below_mean(b):
    mean = b.mean_row()
    return truth(b.agg("below_mean", lambda: F.count_if(b.v < mean)))


@native
def value_count(b, value):
    return truth(b.agg(f"is_{value}", lambda: F.count_if(F.isnan(b.v) if value != value else b.v == float(value))))


@native
def range_count(b, min, max):  # noqa: A002
    return truth(b.agg(f"in_{min}_{max}", lambda: F.count_if((b.v >= float(min)) & (b.v < float(max)))))


@native
def count_above(b, t):
    return b.agg(f"ge_{t}", lambda: F.avg(truth(b.v >= float(t))))


@native
def count_below(b, t):
    return b.agg(f"le_{t}", lambda: F.avg(truth(b.v <= float(t))))


@native
def percentage_of_reoccurring_values_to_all_values(b):
    same, first = b.same(), b.first_of_value()
    return b.agg("again_values", lambda: F.count_if(first & (same > 1)) / F.count_if(first))


@native
def percentage_of_reoccurring_datapoints_to_all_datapoints(b):
    same = b.same()
    return b.agg("again_points", lambda: F.avg(truth(same > 1)))


@native
def sum_of_reoccurring_values(b):
    same, first = b.same(), b.first_of_value()
    return b.agg("again_sum_values", lambda: zero(F.sum(F.when(first & (same > 1), b.v))))


@native
def sum_of_reoccurring_data_points(b):
    same = b.same()
    return b.agg("again_sum_points", lambda: zero(F.sum(F.when(same > 1, b.v))))


@native
def ratio_value_number_to_time_series_length(b):
    first = b.first_of_value()
    return b.agg("values", lambda: F.count_if(first)) / b.n()


@native
def binned_entropy(b, max_bins):
    low, high, n = b.of_group("min", F.min), b.of_group("max", F.max), b.count_row()
    place = b.row(1, f"_bin{max_bins}", lambda: F.when(high > low, F.least(F.floor((b.v - low) / (high - low) * max_bins), F.lit(max_bins - 1))).otherwise(0))
    here = b.row(2, f"_in_bin{max_bins}", lambda: F.count(F.lit(1)).over(Window.partitionBy(*KEYS, f"_bin{max_bins}")))
    del place
    # Every point contributes the log of its bin's share: the mean over points is the sum over bins of p ln p.
    return b.agg(f"bin_entropy{max_bins}", lambda: -F.avg(F.ln(here / n)) + 0.0)


@native
def benford_correlation(b):
    digit = F.regexp_extract(F.abs(b.v).cast("string"), "[1-9]", 0)
    shares = [b.agg(f"digit{d}", lambda d=d: F.avg(truth(digit == str(d)))) for d in range(1, 10)]
    import math

    law = [math.log10(1 + 1 / d) for d in range(1, 10)]
    mean_law = sum(law) / 9
    mean_share = sum(shares[1:], shares[0]) / 9
    cov = sum(((s - mean_share) * (y - mean_law) for s, y in zip(shares[1:], law[1:])), (shares[0] - mean_share) * (law[0] - mean_law))
    var = sum(((s - mean_share) * (s - mean_share) for s in shares[1:]), (shares[0] - mean_share) * (shares[0] - mean_share))
    return F.try_divide(cov, F.sqrt(var * sum((y - mean_law) ** 2 for y in law)))


# --- changes ----------------------------------------------------------------------------------------------------------


@native
def cid_ce(b, normalize):
    d = b.v - b.shifted(-1)
    root = F.sqrt(zero(b.agg("changes_squared", lambda: F.sum(d * d))))
    return F.when(b.sd() > 0, root / b.sd()).otherwise(0.0) if normalize else root


@native
def mean_abs_change(b):
    d = b.v - b.shifted(-1)
    return b.agg("mean_move", lambda: F.avg(F.abs(d)))


@native
def absolute_sum_of_changes(b):
    d = b.v - b.shifted(-1)
    return b.agg("moves", lambda: zero(F.sum(F.abs(d))))


@native
def mean_change(b):
    t = b.t()
    first, last = b.agg("first", lambda: F.min_by(V, t)), b.agg("last", lambda: F.max_by(V, t))
    return F.when(b.n() > 1, (last - first) / (b.n() - 1))


@native
def mean_second_derivative_central(b):
    t, n = b.t(), b.count_row()
    at = lambda name, where: b.agg(name, lambda: F.max(F.when(where, b.v)))
    ends = at("v_last", t == n - 1) - at("v_last2", t == n - 2) - at("v_second", t == 1) + at("v_first", t == 0)
    return F.when(b.n() > 2, ends / (2 * (b.n() - 2)))


def _run(b: Build, name: str, inside: Callable[[Column], Column]) -> Column:
    """The longest run of points inside, by islands."""
    b.mean_row()
    before = b.shifted(-1)
    turn = b.row(1, f"_turn_{name}", lambda: F.when(before.isNull() | (inside(b.v) != inside(before)), 1).otherwise(0))
    island = b.row(2, f"_island_{name}", lambda: F.sum(turn).over(b.ordered.rowsBetween(Window.unboundedPreceding, 0)))
    size = b.row(3, f"_run_{name}", lambda: F.count(F.lit(1)).over(Window.partitionBy(*KEYS, f"_island_{name}")))
    del island
    return truth(b.agg(f"longest_{name}", lambda: F.coalesce(F.max(F.when(inside(b.v), size)), F.lit(0))))


@native
def longest_strike_below_mean(b):
    return _run(b, "below", lambda v: v < b.mean_row())


@native
def longest_strike_above_mean(b):
    return _run(b, "above", lambda v: v > b.mean_row())


@native
def number_crossing_m(b, m):
    before = b.shifted(-1)
    return truth(b.agg(f"cross_{m}", lambda: F.count_if((b.v > float(m)) != (before > float(m)))))


@native
def number_peaks(b, n):
    t, count = b.t(), b.count_row()
    left = b.row(0, f"_left{n}", lambda: F.max(V).over(b.ordered.rowsBetween(-n, -1)))
    right = b.row(0, f"_right{n}", lambda: F.max(V).over(b.ordered.rowsBetween(1, n)))
    return truth(b.agg(f"peaks{n}", lambda: F.count_if((b.v > left) & (b.v > right) & (t >= n) & (t < count - n))))


@native
def change_quantiles(b, ql, qh, isabs, f_agg):
    if f_agg not in ("mean", "var", "std", "sum", "min", "max", "median"):
        raise ValueError(f"unknown f_agg {f_agg!r}")
    if ql >= qh:
        return b.n() * 0.0
    lo, hi = (b.of_group(f"q{q}", lambda v, q=q: F.percentile(v, q)) for q in (ql, qh))
    before = b.shifted(-1)
    d = F.abs(b.v - before) if isabs else b.v - before
    inside = (lo < hi) & b.v.between(lo, hi) & before.between(lo, hi)
    f = {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}[f_agg]
    return b.agg(f"cq_{ql}_{qh}_{isabs}_{f_agg}", lambda: zero(f(F.when(inside, d))))


@native
def time_reversal_asymmetry_statistic(b, lag):
    one, two = b.shifted(lag), b.shifted(2 * lag)
    return b.agg(f"trev{lag}", lambda: zero(F.avg(two * two * one - one * b.v * b.v)))


@native
def c3(b, lag):
    one, two = b.shifted(lag), b.shifted(2 * lag)
    return b.agg(f"c3_{lag}", lambda: zero(F.avg(two * one * b.v)))


@native
def autocorrelation(b, lag):
    mean, later = b.mean_row(), b.shifted(lag)
    total = b.agg(f"acf{lag}", lambda: F.sum((b.v - mean) * (later - mean)))
    return F.when((b.n() > lag) & (b.var() > 1e-16), F.try_divide(total, (b.n() - lag) * b.var()))


# --- places -----------------------------------------------------------------------------------------------------------


def _place(b: Build, extreme: str, last: bool) -> Column:
    t, value = b.t(), b.of_group(extreme, F.max if extreme == "max" else F.min)
    if last:
        return (b.agg(f"last_{extreme}", lambda: F.max(F.when(b.v == value, t))) + 1) / b.n()
    return b.agg(f"first_{extreme}", lambda: F.min(F.when(b.v == value, t))) / b.n()


@native
def last_location_of_maximum(b):
    return _place(b, "max", True)


@native
def first_location_of_maximum(b):
    return _place(b, "max", False)


@native
def last_location_of_minimum(b):
    return _place(b, "min", True)


@native
def first_location_of_minimum(b):
    return _place(b, "min", False)


@native
def index_mass_quantile(b, q):
    t = b.t()
    so_far = b.row(0, "_mass", lambda: F.sum(F.abs(b.v)).over(b.ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = b.row(0, "_all_mass", lambda: F.sum(F.abs(b.v)).over(b.whole))
    return b.agg(f"mass_{q}", lambda: F.min(F.when((whole > 0) & (so_far / whole >= q), t + 1))) / b.n()


@native
def mean_n_absolute_max(b, number_of_maxima):
    if number_of_maxima <= 0:
        raise AssertionError("number_of_maxima must be positive")
    largest = F.slice(F.sort_array(F.transform(b.series(), F.abs), asc=False), 1, number_of_maxima)
    return F.when(b.n() > number_of_maxima, F.aggregate(largest, F.lit(0.0), lambda a, x: a + x) / number_of_maxima)


# --- trends -----------------------------------------------------------------------------------------------------------


@F.pandas_udf(DoubleType())
def _two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for a, k in zip(r, n):
        if a != a or k != k or k < 2:
            out.append(None)
        elif k == 2:
            out.append(0.0 if a else 1.0)
        else:
            out.append(kernels.student_two_sided(a * ((k - 2) / ((1 - a + 1e-20) * (1 + a + 1e-20))) ** 0.5, k - 2))
    return pd.Series(out, dtype="float64")


def _trend(b: Build, name: str, x: Column, y: Column, attr: str) -> Column:
    """Least squares of y on x from their moments; y NULL: not a point."""
    both = F.when(y.isNotNull(), x)
    n = b.agg(f"{name}_n", lambda: F.count(y).cast("double"))
    cov = b.agg(f"{name}_cov", lambda: F.covar_pop(y, both))
    vx, vy = b.agg(f"{name}_vx", lambda: F.var_pop(both)), b.agg(f"{name}_vy", lambda: F.var_pop(y))
    slope = F.try_divide(cov, vx)
    r = F.when(vy > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(vx * vy))))).otherwise(0.0)
    r = F.when(vx > 0, r)
    if attr == "slope":
        return slope
    if attr == "intercept":
        return b.agg(f"{name}_my", lambda: F.avg(y)) - slope * b.agg(f"{name}_mx", lambda: F.avg(both))
    if attr == "rvalue":
        return r
    if attr == "stderr":
        return F.when(vx > 0, F.when(n > 2, F.sqrt((1 - r * r) * vy / vx / (n - 2))).otherwise(0.0))
    if attr == "pvalue":
        return _two_sided(r, n)
    raise ValueError(f"unknown attribute {attr!r} of a trend")


@native
def linear_trend(b, attr):
    return _trend(b, "trend", b.t(), b.v, attr)


@native
def linear_trend_timewise(b, attr):
    start = b.row(0, "_start", lambda: F.first("_ts").over(b.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return _trend(b, "timewise", (F.unix_micros("_ts") - F.unix_micros(start)) / 3.6e9, b.v, attr)


@native
def agg_linear_trend(b, attr, chunk_len, f_agg):
    f = {"max": F.max, "min": F.min, "mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "sum": F.sum}[f_agg]
    t = b.t()
    chunk = b.row(1, f"_chunk{chunk_len}", lambda: F.floor(t / chunk_len))
    value = b.row(2, f"_chunk{chunk_len}_{f_agg}", lambda: F.when(t % chunk_len == 0, f(V).over(Window.partitionBy(*KEYS, f"_chunk{chunk_len}"))))
    return F.when(b.n() > chunk_len, _trend(b, f"chunks{chunk_len}{f_agg}", chunk.cast("double"), value, attr))


@native
def energy_ratio_by_chunks(b, num_segments, segment_focus):
    if not 0 <= segment_focus < num_segments:
        raise AssertionError("segment_focus must be one of the segments")
    t, n = b.t(), b.count_row()
    size, more = F.floor(n / num_segments), n % num_segments
    # The first ``more`` segments have one point more.
    segment = b.row(1, f"_segment{num_segments}", lambda: F.when(t < more * (size + 1), F.floor(t / (size + 1))).otherwise(more + F.floor(F.try_divide(t - more * (size + 1), size))))
    part = b.agg(f"energy{num_segments}_{segment_focus}", lambda: zero(F.sum(F.when(segment == segment_focus, b.v * b.v))))
    return F.try_divide(part, b.squares())
