"""Calculators on many series of one length at once: numpy on a matrix with a row per series.

The results are those of the Spark expressions in ``native`` and of the ``kernels``, for finite values; NaN where they are not defined. A
calculator that is not worth a matrix at a length (or has none here) gives None: its kernel then runs series by series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from chronofold.functions import kernels
from chronofold.functions.kernels import KERNELS, NAN

BLOCKS: dict[str, Callable[[Block, Sequence[dict]], np.ndarray | None]] = {}
#: Up to this length, pairs of points of one series are formed.
PAIRS = 128


class Block:
    """A matrix of series, and what several calculators need of it, each built once."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, (self.rows, self.n) = x, x.shape
        self._kept: dict = {}

    def keep(self, name: object, make: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def full(self, value: float) -> np.ndarray:
        return np.full(self.rows, value)

    @property
    def mean(self) -> np.ndarray:
        return self.keep("mean", lambda: np.cumsum(self.x, axis=1)[:, -1] / self.n)

    @property
    def centred(self) -> np.ndarray:
        # From the first value, so that a constant has no variance.
        def make():
            y = self.x - self.x[:, :1]
            return y - y.mean(axis=1, keepdims=True)

        return self.keep("centred", make)

    @property
    def var(self) -> np.ndarray:
        return self.keep("var", lambda: (self.centred**2).mean(axis=1))

    @property
    def sd(self) -> np.ndarray:
        return self.keep("sd", lambda: np.sqrt(self.var))

    @property
    def low(self) -> np.ndarray:
        return self.keep("low", lambda: self.x.min(axis=1))

    @property
    def high(self) -> np.ndarray:
        return self.keep("high", lambda: self.x.max(axis=1))

    @property
    def squares(self) -> np.ndarray:
        return self.keep("squares", lambda: (self.x**2).sum(axis=1))

    @property
    def sorted(self) -> np.ndarray:
        return self.keep("sorted", lambda: np.sort(self.x, axis=1))

    @property
    def steps(self) -> np.ndarray:
        return self.keep("steps", lambda: np.diff(self.x, axis=1))

    def quantile(self, q: float) -> np.ndarray:
        def make():
            at = (self.n - 1) * q
            lo, hi = math.floor(at), math.ceil(at)
            a, b = self.sorted[:, lo], self.sorted[:, hi]
            return a if lo == hi else np.where(a == b, a, (hi - at) * a + (at - lo) * b)

        return self.keep(("quantile", q), make)

    @property
    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """For the sorted values: is it the first of its value, is its value there again?"""

        def make():
            same = self.sorted[:, 1:] == self.sorted[:, :-1]
            edge = np.zeros((self.rows, 1), bool)
            before, after = np.hstack([edge, same]), np.hstack([same, edge])
            return ~before, before | after

        return self.keep("repeats", make)

    def acf(self, most: int) -> np.ndarray:
        """``kernels.adjusted_acf`` of every row, for short series."""

        def make():
            y = self.x - self.x.mean(axis=1, keepdims=True)
            return np.stack([(y[:, : self.n - k] * y[:, k:]).sum(axis=1) / (self.n - k) for k in range(most + 1)], axis=1)

        return self.keep(("acf", most), make)

    @property
    def std(self) -> np.ndarray:
        return self.keep("std", lambda: np.std(self.x, axis=1))

    @property
    def spectrum(self) -> np.ndarray:
        return self.keep("spectrum", lambda: np.fft.rfft(self.x, axis=1))


def block(f: Callable[[Block, Sequence[dict]], np.ndarray | None]):
    BLOCKS[f.__name__] = f
    return f


def each(f: Callable[..., np.ndarray]):
    """From a function of the block and one parameter set."""
    BLOCKS[f.__name__] = lambda b, params: np.stack([np.asarray(f(b, **(p or {})), float) for p in params], axis=1)
    return f


def _divide(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.where(np.asarray(b) == 0, NAN, a / np.where(np.asarray(b) == 0, 1.0, b))


def _simple(name: str, f: Callable[[Block], np.ndarray]) -> None:
    f.__name__ = name
    each(f)


# --- moments, extremes, counts ----------------------------------------------------------------------------------------

_simple("variance_larger_than_standard_deviation", lambda b: b.var > np.sqrt(b.var))
_simple("has_duplicate_max", lambda b: (b.x == b.high[:, None]).sum(axis=1) >= 2)
_simple("has_duplicate_min", lambda b: (b.x == b.low[:, None]).sum(axis=1) >= 2)
_simple("has_duplicate", lambda b: b.repeats[1].any(axis=1))
_simple("sum_values", lambda b: b.x.sum(axis=1))
_simple("abs_energy", lambda b: b.squares)
_simple("median", lambda b: b.quantile(0.5))
_simple("mean", lambda b: b.mean)
_simple("length", lambda b: b.full(b.n))
_simple("standard_deviation", lambda b: b.sd)
_simple("variance", lambda b: b.var)
_simple("variation_coefficient", lambda b: _divide(b.sd, b.mean))
_simple("root_mean_square", lambda b: np.sqrt(b.squares / b.n))
_simple("maximum", lambda b: b.high)
_simple("minimum", lambda b: b.low)
_simple("absolute_maximum", lambda b: np.maximum(np.abs(b.high), np.abs(b.low)))
_simple("count_above_mean", lambda b: (b.x > b.mean[:, None]).sum(axis=1))
_simple("count_below_mean", lambda b: (b.x < b.mean[:, None]).sum(axis=1))
_simple("percentage_of_reoccurring_values_to_all_values", lambda b: (b.repeats[0] & b.repeats[1]).sum(axis=1) / b.repeats[0].sum(axis=1))
_simple("percentage_of_reoccurring_datapoints_to_all_datapoints", lambda b: b.repeats[1].mean(axis=1))
_simple("sum_of_reoccurring_values", lambda b: np.where(b.repeats[0] & b.repeats[1], b.sorted, 0.0).sum(axis=1))
_simple("sum_of_reoccurring_data_points", lambda b: np.where(b.repeats[1], b.sorted, 0.0).sum(axis=1))
_simple("ratio_value_number_to_time_series_length", lambda b: b.repeats[0].sum(axis=1) / b.n)


@each
def ratio_beyond_r_sigma(b, r):
    return (np.abs(b.x - b.mean[:, None]) > r * b.sd[:, None]).mean(axis=1)


@each
def large_standard_deviation(b, r):
    return b.sd > r * (b.high - b.low)


@each
def symmetry_looking(b, r):
    return np.abs(b.mean - b.quantile(0.5)) < r * (b.high - b.low)


@each
def skewness(b):
    if b.n < 3:
        return b.full(NAN)
    return np.where(b.var > 0, math.sqrt(b.n * (b.n - 1)) / (b.n - 2) * _divide((b.centred**3).mean(axis=1), b.var**1.5), 0.0)


@each
def kurtosis(b):
    n = b.n
    if n < 4:
        return b.full(NAN)
    g = _divide((b.centred**4).mean(axis=1), b.var**2) - 3
    return np.where(b.var > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6), 0.0)


@each
def quantile(b, q):
    return b.quantile(q)


@each
def value_count(b, value):
    return (b.x == float(value)).sum(axis=1)


@each
def range_count(b, min, max):  # noqa: A002
    return ((b.x >= float(min)) & (b.x < float(max))).sum(axis=1)


@each
def count_above(b, t):
    return (b.x >= float(t)).mean(axis=1)


@each
def count_below(b, t):
    return (b.x <= float(t)).mean(axis=1)


def _edges(lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """``numpy.linspace`` row by row: given all rows at once, it rounds another way if one of them is flat."""
    edges = np.arange(bins + 1.0) * ((hi - lo) / bins)[:, None] + lo[:, None]
    edges[:, -1] = hi
    return edges


def _entropy(place: np.ndarray, bins: int) -> np.ndarray:
    """Of the shares of the bins, row by row."""
    rows, n = place.shape
    counts = np.bincount((np.arange(rows)[:, None] * bins + place).ravel(), minlength=rows * bins).reshape(rows, bins)
    p = counts / n
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1) + 0.0


@each
def binned_entropy(b, max_bins):
    width = (b.high - b.low)[:, None]
    place = np.floor((b.x - b.low[:, None]) / np.where(width > 0, width, 1.0) * max_bins)
    return _entropy(np.minimum(np.where(width > 0, place, 0), max_bins - 1).astype(int), max_bins)


@each
def benford_correlation(b):
    first = np.array([int(repr(v).lstrip("0.")[:1] or 0) for v in np.abs(b.x).ravel().tolist()]).reshape(b.x.shape)
    shares = np.stack([(first == d).mean(axis=1) for d in range(1, 10)], axis=1)
    law = np.log10(1 + 1 / np.arange(1, 10))
    law = law - law.mean()
    shares = shares - shares.mean(axis=1, keepdims=True)
    return _divide(shares @ law, np.sqrt((shares**2).sum(axis=1) * (law**2).sum()))


# --- changes ----------------------------------------------------------------------------------------------------------

_simple("mean_abs_change", lambda b: np.abs(b.steps).mean(axis=1) if b.n > 1 else b.full(NAN))
_simple("absolute_sum_of_changes", lambda b: np.abs(b.steps).sum(axis=1))
_simple("mean_change", lambda b: (b.x[:, -1] - b.x[:, 0]) / (b.n - 1) if b.n > 1 else b.full(NAN))
_simple("mean_second_derivative_central", lambda b: (b.x[:, -1] - b.x[:, -2] - b.x[:, 1] + b.x[:, 0]) / (2 * (b.n - 2)) if b.n > 2 else b.full(NAN))


@each
def cid_ce(b, normalize):
    root = np.sqrt((b.steps**2).sum(axis=1))
    return np.where(b.sd > 0, _divide(root, b.sd), 0.0) if normalize else root


def _longest(inside: np.ndarray) -> np.ndarray:
    at = np.arange(inside.shape[1])
    return (at - np.maximum.accumulate(np.where(inside, -1, at), axis=1)).max(axis=1)


_simple("longest_strike_below_mean", lambda b: _longest(b.x < b.mean[:, None]))
_simple("longest_strike_above_mean", lambda b: _longest(b.x > b.mean[:, None]))


@each
def number_crossing_m(b, m):
    above = b.x > float(m)
    return (above[:, 1:] != above[:, :-1]).sum(axis=1)


@each
def number_peaks(b, n):
    if b.n < 2 * n + 1:
        return b.full(0.0)
    size = b.n - 2 * n
    top = np.ones((b.rows, size), bool)
    for k in range(1, n + 1):
        top &= (b.x[:, n : n + size] > b.x[:, n - k : n - k + size]) & (b.x[:, n : n + size] > b.x[:, n + k : n + k + size])
    return top.sum(axis=1)


@each
def change_quantiles(b, ql, qh, isabs, f_agg):
    if f_agg not in ("mean", "var", "std", "sum", "min", "max", "median"):
        raise ValueError(f"unknown f_agg {f_agg!r}")
    if ql >= qh or b.n < 2:
        return b.full(0.0)

    def make():
        lo, hi = b.quantile(ql)[:, None], b.quantile(qh)[:, None]
        inside = (b.x >= lo) & (b.x <= hi) & (lo < hi)
        inside = inside[:, 1:] & inside[:, :-1]
        return inside, inside.sum(axis=1)

    inside, count = b.keep(("inside", ql, qh), make)
    d = np.abs(b.steps) if isabs else b.steps
    some = np.maximum(count, 1)
    if f_agg in ("min", "max", "median"):
        f = {"min": np.nanmin, "max": np.nanmax, "median": np.nanmedian}[f_agg]
        return np.array([f(v[i]) if i.any() else 0.0 for v, i in zip(d, inside)])
    total = np.where(inside, d, 0.0).sum(axis=1)
    if f_agg in ("mean", "sum"):
        return total / some if f_agg == "mean" else total
    var = (np.where(inside, d - (total / some)[:, None], 0.0) ** 2).sum(axis=1) / some
    return var if f_agg == "var" else np.sqrt(var)


def _lagged(b: Block, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = b.n - 2 * lag
    return b.x[:, :size], b.x[:, lag : lag + size], b.x[:, 2 * lag :]


@each
def time_reversal_asymmetry_statistic(b, lag):
    if b.n <= 2 * lag:
        return b.full(0.0)
    v, one, two = _lagged(b, lag)
    return (two * two * one - one * v * v).mean(axis=1)


@each
def c3(b, lag):
    if b.n <= 2 * lag:
        return b.full(0.0)
    v, one, two = _lagged(b, lag)
    return (two * one * v).mean(axis=1)


@each
def autocorrelation(b, lag):
    if b.n <= lag:
        return b.full(NAN)
    y = b.centred
    return np.where(b.var > 1e-16, _divide((y[:, : b.n - lag] * y[:, lag:]).sum(axis=1), (b.n - lag) * b.var), NAN)


# --- places -----------------------------------------------------------------------------------------------------------

_simple("first_location_of_maximum", lambda b: b.x.argmax(axis=1) / b.n)
_simple("first_location_of_minimum", lambda b: b.x.argmin(axis=1) / b.n)
_simple("last_location_of_maximum", lambda b: (b.n - b.x[:, ::-1].argmax(axis=1)) / b.n)
_simple("last_location_of_minimum", lambda b: (b.n - b.x[:, ::-1].argmin(axis=1)) / b.n)


@each
def index_mass_quantile(b, q):
    mass = b.keep("mass", lambda: np.cumsum(np.abs(b.x), axis=1))
    whole = mass[:, -1:]
    reached = (mass / np.where(whole > 0, whole, 1.0) >= q) & (whole > 0)
    return np.where(reached.any(axis=1), (reached.argmax(axis=1) + 1) / b.n, NAN)


@each
def mean_n_absolute_max(b, number_of_maxima):
    if number_of_maxima <= 0:
        raise AssertionError("number_of_maxima must be positive")
    if b.n <= number_of_maxima:
        return b.full(NAN)
    return np.sort(np.abs(b.x), axis=1)[:, b.n - number_of_maxima :].sum(axis=1) / number_of_maxima


# --- trends -----------------------------------------------------------------------------------------------------------


def _trend(b: Block, name: object, y: np.ndarray, attr: str) -> np.ndarray:
    """Least squares of the rows of y on 0, 1, .."""
    n = y.shape[1]

    def make():
        x = np.arange(n) - (n - 1) / 2
        d = y - y[:, :1]
        d = d - d.mean(axis=1, keepdims=True)
        vx, vy, cov = (x**2).mean(), (d**2).mean(axis=1), (d * x).mean(axis=1)
        r = np.where(vy > 0, np.clip(_divide(cov, np.sqrt(vx * vy)), -1.0, 1.0), 0.0) if vx > 0 else np.full(len(y), NAN)
        return vx, vy, _divide(cov, vx), r

    vx, vy, slope, r = b.keep(("trend", name), make)
    if attr == "slope":
        return slope
    if attr == "intercept":
        return y.mean(axis=1) - slope * ((n - 1) / 2)
    if attr == "rvalue":
        return r
    if attr == "stderr":
        return np.full(len(y), NAN) if not vx > 0 else np.zeros(len(y)) if n <= 2 else np.sqrt((1 - r * r) * vy / vx / (n - 2))
    if attr == "pvalue":
        if n < 2:
            return np.full(len(y), NAN)
        if n == 2:
            return np.where(np.isnan(r), NAN, np.where(r != 0, 0.0, 1.0))
        t = r * ((n - 2) / ((1 - r + 1e-20) * (1 + r + 1e-20))) ** 0.5
        return np.array([kernels.student_two_sided(v, n - 2) for v in t.tolist()])
    raise ValueError(f"unknown attribute {attr!r} of a trend")


@each
def linear_trend(b, attr):
    return _trend(b, "all", b.x, attr)


@each
def agg_linear_trend(b, attr, chunk_len, f_agg):
    if b.n <= chunk_len:
        return b.full(NAN)
    f = {"max": np.max, "min": np.min, "mean": np.mean, "var": np.var, "std": np.std, "sum": np.sum}[f_agg]

    def make():
        whole = b.n // chunk_len
        y = f(b.x[:, : whole * chunk_len].reshape(b.rows, whole, chunk_len), axis=2)
        return y if whole * chunk_len == b.n else np.hstack([y, f(b.x[:, whole * chunk_len :], axis=1)[:, None]])

    return _trend(b, (chunk_len, f_agg), b.keep(("chunks", chunk_len, f_agg), make), attr)


@each
def energy_ratio_by_chunks(b, num_segments, segment_focus):
    if not 0 <= segment_focus < num_segments:
        raise AssertionError("segment_focus must be one of the segments")
    size, more = divmod(b.n, num_segments)
    start = segment_focus * size + min(segment_focus, more)
    return _divide((b.x[:, start : start + size + (segment_focus < more)] ** 2).sum(axis=1), b.squares)


# --- autocorrelation and models ---------------------------------------------------------------------------------------


@block
def agg_autocorrelation(b, params):
    if b.n > 512:
        return None
    n, most = b.n, max(int(p["maxlag"]) for p in params)
    acf = np.zeros((b.rows, max(1, n - 1)))
    if n > 1:
        some = np.var(b.x, axis=1) >= 1e-10
        cov = b.acf(min(most, n - 1))
        acf = acf[:, : max(1, cov.shape[1] - 1)]
        acf[some] = (cov[some, 1:] / cov[some, :1])[:, : acf.shape[1]]
    out = []
    for p in params:
        part, f = acf[:, : int(p["maxlag"])], getattr(np, p["f_agg"], None)
        out.append(f(part, axis=1) if f is not None and part.shape[1] else b.full(NAN))
    # A constant keeps zeros at all lags; their mean, median and variance are the same for any number of them.
    return np.stack(out, axis=1) if {p["f_agg"] for p in params} <= {"mean", "median", "var", "std", "min", "max", "sum"} else None


@block
def partial_autocorrelation(b, params):
    if b.n > 512:
        return None
    lags = [int(p["lag"]) for p in params]
    n, most = b.n, max(lags)
    pacf = np.full((b.rows, most + 1), NAN)
    usable = min(most, n // 2 - 1) if most >= n // 2 else most
    if n > 1 and usable > 0:
        cov = b.acf(usable)
        pacf[:, 0] = 1.0
        phi, error = np.zeros((b.rows, usable + 1)), cov[:, 0]
        for k in range(1, usable + 1):
            a = (cov[:, k] - (phi[:, 1:k] * cov[:, k - 1 : 0 : -1]).sum(axis=1)) / error
            phi[:, 1:k] = phi[:, 1:k] - a[:, None] * phi[:, 1:k][:, ::-1]
            phi[:, k] = a
            error = error * (1 - a * a)
            pacf[:, k] = a
    return pacf[:, lags]


def _ols(y: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``kernels._ols`` of a stack: (sums of squares, t of the coefficients)."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    most = s.max(axis=1, keepdims=True)
    pinv = (vt.transpose(0, 2, 1) * np.where(s > 1e-15 * most, 1 / s, 0.0)[:, None, :]) @ u.transpose(0, 2, 1)
    beta = (pinv @ y[:, :, None])[:, :, 0]
    ssr = ((y - (a @ beta[:, :, None])[:, :, 0]) ** 2).sum(axis=1)
    dof = y.shape[1] - (s > most * max(a.shape[1:]) * np.finfo(float).eps).sum(axis=1)
    var = (pinv**2).sum(axis=2) * np.where(dof > 0, ssr / np.maximum(dof, 1), NAN)[:, None]
    return ssr, beta / np.sqrt(var)


@block
def augmented_dickey_fuller(b, params):
    if b.n > PAIRS or {p.get("autolag", "AIC") for p in params} != {"AIC"}:
        return None
    n = b.n
    most = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    found = np.full((b.rows, 3), NAN)
    moves = np.nonzero(b.high > b.low)[0]
    if n >= 4 and most >= 0 and len(moves):
        x = b.x[moves]
        d = np.diff(x, axis=1)

        def design(lag: int) -> tuple[np.ndarray, np.ndarray]:
            rows = d.shape[1] - lag
            return d[:, lag:], np.stack([x[:, -rows - 1 : -1], *[d[:, lag - k : d.shape[1] - k] for k in range(1, lag + 1)]], axis=2)

        y, a = design(most)
        m, scores = y.shape[1], []
        for lag in range(most + 1):
            ssr, _ = _ols(y, np.concatenate([np.ones((len(y), m, 1)), a[:, :, : lag + 1]], axis=2))
            scores.append(m * (math.log(2 * math.pi) + np.log(ssr / m) + 1) + 2 * (lag + 2))
        used = np.argmin(np.stack(scores, axis=1), axis=1)
        for lag in np.unique(used):
            here = np.nonzero(used == lag)[0]
            y, a = design(int(lag))
            if y.shape[1] > a.shape[2] + 1:
                _, t = _ols(y[here], np.concatenate([a[here], np.ones((len(here), y.shape[1], 1))], axis=2))
                found[moves[here]] = [(v, kernels.mackinnon_p(v), float(lag)) for v in t[:, 0].tolist()]
    place = {"teststat": 0, "pvalue": 1, "usedlag": 2}
    return np.stack([found[:, place[p["attr"]]] if p["attr"] in place else b.full(NAN) for p in params], axis=1)


@block
def ar_coefficient(b, params):
    if any(b.n - int(p["k"]) >= int(p["k"]) + 1 for p in params):
        return None
    return np.stack([b.full(0.0 if int(p["coeff"]) == int(p["k"]) else NAN) for p in params], axis=1)


def _drift_polynomials(b: Block, m: int, r: int) -> np.ndarray | None:
    """``kernels._drift_polynomial`` of every row."""
    out = np.full((b.rows, m + 1), NAN)
    if b.n < 3:
        return out
    level, step = b.x[:, :-1], b.steps
    edges = np.quantile(level, np.linspace(0, 1, r + 1), axis=1).T
    fit = np.nonzero((np.diff(np.sort(edges, axis=1), axis=1) > 0).all(axis=1))[0]
    if not len(fit):
        return out
    level, step, edges = level[fit], step[fit], edges[fit]
    place = np.clip((edges[:, None, :] < level[:, :, None]).sum(axis=2), 1, r)
    flat = (np.arange(len(fit))[:, None] * (r + 1) + place).ravel()
    count, px, py = (np.bincount(flat, w, len(fit) * (r + 1)).reshape(len(fit), r + 1) for w in (np.ones(flat.size), level.ravel(), step.ravel()))
    sizes = (count > 0).sum(axis=1)
    for k in np.unique(sizes):
        here = np.nonzero(sizes == k)[0]
        some = count[here] > 0
        x, y = ((v[here][some] / count[here][some]).reshape(len(here), k) for v in (px, py))
        a = x[:, :, None] ** np.arange(m, -1, -1)
        scale = np.sqrt((a * a).sum(axis=1))
        u, s, vt = np.linalg.svd(a / scale[:, None, :], full_matrices=False)
        inverse = np.where(s > k * np.finfo(float).eps * s.max(axis=1, keepdims=True), 1 / s, 0.0)
        c = (vt.transpose(0, 2, 1) @ (inverse * (u.transpose(0, 2, 1) @ y[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
        out[fit[here]] = c / scale
    return out


@block
def friedrich_coefficients(b, params):
    if b.n > PAIRS:
        return None
    if any(p["coeff"] < 0 for p in params):
        raise AssertionError("coefficients must be positive or zero")
    polys = [b.keep(("drift", p["m"], p["r"]), lambda p=p: _drift_polynomials(b, p["m"], p["r"])) for p in params]
    return np.stack([c[:, p["coeff"]] if p["coeff"] < c.shape[1] else b.full(NAN) for p, c in zip(params, polys)], axis=1)


@block
def max_langevin_fixed_point(b, params):
    if b.n > PAIRS:
        return None
    out = []
    for p in params:
        poly = b.keep(("drift", p["m"], p["r"]), lambda p=p: _drift_polynomials(b, p["m"], p["r"]))
        top = b.full(NAN)
        known = ~np.isnan(poly).any(axis=1)
        plain = np.nonzero(known & (poly[:, 0] != 0) & (poly[:, -1] != 0))[0]
        if len(plain) and p["m"] > 0:
            companion = np.zeros((len(plain), p["m"], p["m"]))
            companion[:, 0, :] = -poly[plain, 1:] / poly[plain, :1]
            companion[:, np.arange(1, p["m"]), np.arange(p["m"] - 1)] = 1.0
            top[plain] = np.linalg.eigvals(companion).real.max(axis=1)
        for i in np.setdiff1d(np.nonzero(known)[0], plain):
            roots = np.roots(poly[i])
            top[i] = np.max(np.real(roots)) if len(roots) else NAN
        out.append(top)
    return np.stack(out, axis=1)


# --- spectra and wavelets ---------------------------------------------------------------------------------------------


@block
def fft_coefficient(b, params):
    if min(int(p["coeff"]) for p in params) < 0:
        raise AssertionError("coefficients must be positive or zero")
    s = b.spectrum
    parts = {"real": s.real, "imag": s.imag, "abs": np.abs(s), "angle": np.angle(s, deg=True)}
    if bad := {p["attr"] for p in params} - set(parts):
        raise AssertionError(f"unknown attribute {bad}")
    out = np.full((b.rows, len(params)), NAN)
    for j, p in enumerate(params):
        if p["coeff"] < s.shape[1]:
            out[:, j] = parts[p["attr"]][:, p["coeff"]]
    return out


@block
def fft_aggregated(b, params):
    weight = np.abs(b.spectrum)
    total, index = weight.sum(axis=1), np.arange(weight.shape[1], dtype=float)
    m = [np.where(total > 0, (weight * index**k).sum(axis=1) / np.where(total > 0, total, 1.0), NAN) for k in range(5)]
    variance = m[2] - m[1] ** 2
    safe = np.where(variance >= 0.5, variance, NAN)
    values = {"centroid": m[1], "variance": variance, "skew": (m[3] - 3 * m[1] * safe - m[1] ** 3) / safe**1.5, "kurtosis": (m[4] - 4 * m[1] * m[3] + 6 * m[2] * m[1] ** 2 - 3 * m[1]) / safe**2}
    return np.stack([values[p["aggtype"]] for p in params], axis=1)


def _welch(b: Block) -> np.ndarray:
    def make():
        size = b.n
        window = np.ones(1) if size == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        power = np.abs(np.fft.rfft((b.x - b.x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (window**2).sum()
        power[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
        return power

    return b.keep("welch", make)


@block
def spkt_welch_density(b, params):
    if b.n > 256:
        return None
    power = _welch(b)
    return np.stack([power[:, p["coeff"]] if p["coeff"] < power.shape[1] else b.full(NAN) for p in params], axis=1)


@block
def fourier_entropy(b, params):
    if b.n > 256:
        return None
    power = _welch(b)
    most = power.max(axis=1)
    known = most > 0
    scaled = power / np.where(known, most, 1.0)[:, None]
    lo, hi = scaled.min(axis=1), scaled.max(axis=1)
    lo, hi = np.where(lo == hi, lo - 0.5, lo), np.where(lo == hi, hi + 0.5, hi)
    out = []
    for p in params:
        # The bins of numpy.histogram, by its own correction at the edges.
        bins = p["bins"]
        edges = _edges(lo, hi, bins)
        place = np.minimum(((scaled - lo[:, None]) / (hi - lo)[:, None] * bins).astype(int), bins - 1)
        place -= scaled < np.take_along_axis(edges, place, axis=1)
        place += (scaled >= np.take_along_axis(edges, place + 1, axis=1)) & (place != bins - 1)
        out.append(np.where(known, _entropy(place, bins), NAN))
    return np.stack(out, axis=1)


@lru_cache(maxsize=512)
def _wavelet(n: int, width: float) -> np.ndarray:
    """The transform is linear: its matrix."""
    return np.stack([kernels.mexican_hat_transform(e, width) for e in np.eye(n)])


@block
def cwt_coefficients(b, params):
    if b.n > PAIRS:
        return None
    done = {w: b.x @ _wavelet(b.n, w) for w in {p["w"] for p in params}}
    return np.stack([done[p["w"]][:, p["coeff"]] if p["coeff"] < done[p["w"]].shape[1] else b.full(NAN) for p in params], axis=1)


@lru_cache(maxsize=512)
def _ricker(points: int, a: int) -> np.ndarray:
    return kernels.ricker(points, a)[::-1]


def _ridges(tops: list[list[int]], powers: np.ndarray, n: int) -> int:
    """The lines of ``kernels.count_ridge_peaks`` of one series; a line is [row, column, end, length, gap]."""
    widest = len(tops)
    last = max((r for r, t in enumerate(tops) if t), default=None)
    if last is None:
        return 0
    open_ = [[last, c, c, 1, 0] for c in tops[last]]
    done = []
    for r in range(last - 1, -1, -1):
        for line in open_:
            line[4] += 1
        ends = [line[2] for line in open_]
        for c in tops[r]:
            near = min(range(len(ends)), key=lambda i: abs(ends[i] - c)) if ends else -1
            if near >= 0 and abs(ends[near] - c) <= (r + 1) / 4.0:
                line = open_[near]
                open_[near] = [r, c, c, line[3] + 1, 0]
            else:
                open_.append([r, c, c, 1, 0])
        done += [line for line in open_ if line[4] > 1]
        open_ = [line for line in open_ if line[4] <= 1]
    half, odd = divmod(math.ceil(n / 20), 2)
    least, found = math.ceil(widest / 4), 0
    for row, c, _, size, _ in done + open_:
        if size >= least:
            around = np.sort(powers[0, max(c - half, 0) : min(c + half + odd, n)])
            at = 0.1 * (len(around) - 1)
            i = int(at)
            noise = around[i] + (around[min(i + 1, len(around) - 1)] - around[i]) * (at - i)
            found += not abs(powers[row, c] / noise) < 1
    return found


@block
def number_cwt_peaks(b, params):
    if b.n > PAIRS:
        return None
    n, most = b.n, max(int(p["n"]) for p in params)
    powers = np.zeros((b.rows, most, n))
    for w in range(1, most + 1):
        filt = _ricker(min(10 * w, n), w)
        full = np.zeros((b.rows, n + len(filt) - 1))
        for j, f in enumerate(filt):
            full[:, j : j + n] += f * b.x
        powers[:, w - 1] = full[:, (len(filt) - 1) // 2 :][:, :n]
    is_top = np.zeros(powers.shape, bool)
    is_top[:, :, 1:-1] = (powers[:, :, 1:-1] > powers[:, :, :-2]) & (powers[:, :, 1:-1] > powers[:, :, 2:])
    tops = [[[] for _ in range(most)] for _ in range(b.rows)]
    for i, r, c in np.argwhere(is_top).tolist():
        tops[i][r].append(c)
    return np.array([[float(_ridges(t[: int(p["n"])], powers[i], n)) for p in params] for i, t in enumerate(tops)])


# --- entropies and complexities ---------------------------------------------------------------------------------------


def _near(b: Block, tolerance: np.ndarray) -> np.ndarray:
    distance = b.keep("distance", lambda: np.abs(b.x[:, :, None] - b.x[:, None, :]))
    return distance <= tolerance[:, None, None]


def _longer(near: np.ndarray, all_near: np.ndarray) -> np.ndarray:
    """From pairs of templates to pairs of those one point longer."""
    k = all_near.shape[1] - near.shape[1] + 1
    return near[:, :-1, :-1] & all_near[:, k:, k:]


@block
def sample_entropy(b, params):
    if b.n > PAIRS:
        return None
    if b.n < 3:
        return np.full((b.rows, len(params)), NAN)
    near = _near(b, 0.2 * b.std)
    two = _longer(near, near)
    three = _longer(two, near)
    value = -np.log((three.sum(axis=(1, 2)) - (b.n - 2)) / (two.sum(axis=(1, 2)) - (b.n - 1)))
    return np.repeat(value[:, None], len(params), axis=1)


@block
def approximate_entropy(b, params):
    if b.n > PAIRS:
        return None
    out = []
    for p in params:
        m, r = p["m"], p["r"]
        if r < 0:
            raise ValueError("r must be positive")
        if b.n <= m + 1:
            out.append(b.full(0.0))
            continue
        near = _near(b, r * b.std)
        at, phi = near, []
        for k in range(1, m + 2):
            if k > 1:
                at = _longer(at, near)
            size = b.n - k + 1.0
            phi.append(np.log(at.sum(axis=2) / size).sum(axis=1) / size)
        out.append(np.abs(phi[m - 1] - phi[m]))
    return np.stack(out, axis=1)


@block
def lempel_ziv_complexity(b, params):
    if b.n > PAIRS:
        return None
    out = np.empty((b.rows, len(params)))
    for j, p in enumerate(params):
        edges = _edges(b.low, b.high, p["bins"])[:, 1:]
        places = sum((b.x > edges[:, k : k + 1]).astype(np.int64) for k in range(edges.shape[1]))
        for i, text in enumerate(places.tolist()):
            seen: set = set()
            phrase: tuple = ()
            for c in text:
                phrase = (*phrase, c)
                if phrase not in seen:
                    seen.add(phrase)
                    phrase = ()
            out[i, j] = len(seen) / b.n
    return out


@block
def permutation_entropy(b, params):
    if b.n > PAIRS:
        return None
    out = []
    for p in params:
        tau, dimension = p["tau"], p["dimension"]
        if b.n < dimension:
            out.append(b.full(NAN))
            continue
        windows = np.lib.stride_tricks.sliding_window_view(b.x, dimension, axis=1)[:, ::tau]
        ranks = np.argsort(np.argsort(windows, axis=2, kind="stable"), axis=2, kind="stable")
        code = ranks @ (dimension ** np.arange(dimension))
        # A pattern's share, at every window that has it: the mean of its log is the sum of p ln p.
        share = (code[:, :, None] == code[:, None, :]).mean(axis=2)
        out.append(-np.log(share).mean(axis=1) + 0.0)
    return np.stack(out, axis=1)


@block
def matrix_profile(b, params):
    # Below 32 points, 8 is the only window there is room for.
    if b.n >= 32 or any(p.get("windows") is not None for p in params):
        return None
    pick = {"min": np.min, "max": np.max, "mean": np.mean, "median": np.median, "25": lambda v, axis: np.percentile(v, 25, axis=axis), "75": lambda v, axis: np.percentile(v, 75, axis=axis)}
    if bad := {p["feature"] for p in params} - set(pick):
        raise ValueError(f"unknown feature {sorted(bad)} of the matrix profile")
    if b.n < 16:
        return np.full((b.rows, len(params)), NAN)
    rows = kernels._normalised(np.lib.stride_tricks.sliding_window_view(b.x, 8, axis=1))
    corr = rows @ rows.transpose(0, 2, 1) / 8
    at = np.arange(rows.shape[1])
    corr[:, np.abs(at[:, None] - at) <= 2] = -np.inf
    d = np.sqrt(np.maximum(0.0, 16 * (1 - corr.max(axis=2))))
    return np.stack([pick[p["feature"]](d, axis=1) for p in params], axis=1)


#: Values of a matrix in one step: what pairs of its points take stays within some ten MB.
_CELLS = 20_000


def values(calc: str, b: Block, params: Sequence[dict | None]) -> np.ndarray:
    """A row per series, a column per parameter set."""
    with np.errstate(all="ignore"):
        got = BLOCKS[calc](b, params) if calc in BLOCKS else None
        if got is None:
            got = np.array([[NAN if v is None else v for v in KERNELS[calc](x, params)] for x in b.x], float).reshape(b.rows, len(params))
    return got


def blocks_of(x: np.ndarray) -> list[tuple[slice, Block]]:
    size = max(1, _CELLS // x.shape[1])
    return [(slice(i, i + size), Block(x[i : i + size])) for i in range(0, len(x), size)]
