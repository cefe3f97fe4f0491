"""Calculators that have no Spark expression: numpy on one series at a time, many parameter sets in one call.

Each kernel takes the series (float64, in order, no missing values) and a list of parameter sets, and returns one number per set;
NaN where the result is not defined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

NAN = float("nan")
Kernel = Callable[[np.ndarray, Sequence[dict]], list[float]]
KERNELS: dict[str, Kernel] = {}


def kernel(f: Kernel) -> Kernel:
    KERNELS[f.__name__] = f
    return f


def each(f: Callable[..., float]) -> Kernel:
    """A kernel from a function of the series and one parameter set."""

    def run(x: np.ndarray, params: Sequence[dict]) -> list[float]:
        return [f(x, **(p or {})) for p in params]

    KERNELS[f.__name__] = run
    return f


# --- tails of distributions -------------------------------------------------------------------------------------------


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def student_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or dof <= 0:
        return NAN
    if math.isinf(t):
        return 0.0
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


# --- autocorrelation --------------------------------------------------------------------------------------------------


def adjusted_acf(x: np.ndarray, most: int) -> np.ndarray:
    """Autocovariances at lags 0..most with denominators n - lag, over the lag-0 value."""
    n = len(x)
    y = x - x.mean()
    if n > 512:
        size = 1 << (2 * n - 1).bit_length()
        spectrum = np.fft.rfft(y, size)
        cov = np.fft.irfft(spectrum * np.conj(spectrum), size)[: most + 1]
    else:
        cov = np.array([y[: n - k] @ y[k:] for k in range(most + 1)])
    return cov / (n - np.arange(most + 1))


@kernel
def agg_autocorrelation(x, params):
    n, out = len(x), []
    most = max(int(p["maxlag"]) for p in params)
    if n <= 1 or np.var(x) < 1e-10:
        acf = np.zeros(max(1, n - 1) if n > 1 else 1)
        if n == 1:
            acf = np.zeros(1)
    else:
        cov = adjusted_acf(x, min(most, n - 1))
        acf = cov[1:] / cov[0]
    for p in params:
        part = acf[: int(p["maxlag"])]
        f = getattr(np, p["f_agg"], None)
        out.append(float(f(part)) if f is not None and len(part) else NAN)
    return out


@kernel
def partial_autocorrelation(x, params):
    lags = [int(p["lag"]) for p in params]
    n, most = len(x), max(lags)
    pacf = np.full(most + 1, NAN)
    if n > 1:
        usable = min(most, n // 2 - 1) if most >= n // 2 else most
        if usable > 0:
            cov = adjusted_acf(x, usable)
            pacf[0] = 1.0
            phi = np.zeros(usable + 1)
            with np.errstate(all="ignore"):
                error = cov[0]
                for k in range(1, usable + 1):
                    a = (cov[k] - phi[1:k] @ cov[k - 1 : 0 : -1]) / error
                    phi[1:k] = phi[1:k] - a * phi[1:k][::-1]
                    phi[k] = a
                    error = error * (1 - a * a)
                    pacf[k] = a
    return [float(pacf[k]) for k in lags]


# --- unit root --------------------------------------------------------------------------------------------------------

#: The response surface of MacKinnon (1994) for a regression with a constant.
MACKINNON_SMALL = (2.1659, 1.4412, 0.038269)
MACKINNON_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
MACKINNON_STAR, MACKINNON_LEAST, MACKINNON_MOST = -1.61, -18.83, 2.74


def mackinnon_p(stat: float) -> float:
    if math.isnan(stat):
        return NAN
    if stat > MACKINNON_MOST:
        return 1.0
    if stat < MACKINNON_LEAST:
        return 0.0
    coefficients = MACKINNON_SMALL if stat <= MACKINNON_STAR else MACKINNON_LARGE
    return normal_cdf(sum(c * stat**i for i, c in enumerate(coefficients)))


def _ols(y: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    pinv = np.linalg.pinv(a)
    beta = pinv @ y
    rest = y - a @ beta
    ssr = float(rest @ rest)
    dof = len(y) - np.linalg.matrix_rank(a)
    var = np.diag(pinv @ pinv.T) * (ssr / dof if dof > 0 else NAN)
    with np.errstate(all="ignore"):
        t = beta / np.sqrt(var)
    return beta, ssr, t


def _dickey_fuller(x: np.ndarray, autolag: str | None) -> tuple[float, float, float]:
    n = len(x)
    most = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    if n < 4 or most < 0 or np.ptp(x) == 0 or not np.isfinite(x).all():
        return NAN, NAN, NAN
    d = np.diff(x)

    def design(lag: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(d) - lag
        cols = [x[-rows - 1 : -1], *[d[lag - k : len(d) - k] for k in range(1, lag + 1)]]
        return d[lag:], np.column_stack(cols)

    used = most
    if autolag:
        y, a = design(most)
        ones = np.ones((len(y), 1))
        scores = []
        for lag in range(most + 1):
            full = np.hstack([ones, a[:, : lag + 1]])
            _, ssr, t = _ols(y, full)
            m, k = len(y), full.shape[1]
            with np.errstate(divide="ignore"):
                llf = -m / 2 * (math.log(2 * math.pi) + np.log(ssr / m) + 1)
            scores.append((-2 * llf + (2 if autolag == "AIC" else math.log(m)) * k, abs(t[-1])))
        if autolag in ("AIC", "BIC"):
            used = int(np.argmin([s for s, _ in scores]))
        else:
            used = next((lag for lag in range(most, 0, -1) if scores[lag][1] >= 1.6448536269514722), 0)
    y, a = design(used)
    if len(y) <= a.shape[1] + 1:
        return NAN, NAN, NAN
    _, _, t = _ols(y, np.hstack([a, np.ones((len(y), 1))]))
    return float(t[0]), mackinnon_p(float(t[0])), float(used)


@kernel
def augmented_dickey_fuller(x, params):
    done: dict = {}
    out = []
    for p in params:
        lag = p.get("autolag", "AIC")
        if lag not in done:
            try:
                done[lag] = _dickey_fuller(x, lag)
            except np.linalg.LinAlgError:
                done[lag] = (NAN, NAN, NAN)
        place = {"teststat": 0, "pvalue": 1, "usedlag": 2}.get(p["attr"])
        out.append(NAN if place is None else done[lag][place])
    return out


# --- spectra ----------------------------------------------------------------------------------------------------------


@kernel
def fft_coefficient(x, params):
    if min(int(p["coeff"]) for p in params) < 0:
        raise AssertionError("coefficients must be positive or zero")
    spectrum = np.fft.rfft(x)
    parts = {"real": spectrum.real, "imag": spectrum.imag, "abs": np.abs(spectrum), "angle": np.angle(spectrum, deg=True)}
    if bad := {p["attr"] for p in params} - set(parts):
        raise AssertionError(f"unknown attribute {bad}")
    return [float(parts[p["attr"]][p["coeff"]]) if p["coeff"] < len(spectrum) else NAN for p in params]


@kernel
def fft_aggregated(x, params):
    weight = np.abs(np.fft.rfft(x))
    total = weight.sum()
    index = np.arange(len(weight), dtype=float)
    m = [float((index**k) @ weight / total) if total > 0 else NAN for k in range(5)]
    variance = m[2] - m[1] ** 2
    flat = not variance >= 0.5
    values = {
        "centroid": m[1],
        "variance": variance,
        "skew": NAN if flat else (m[3] - 3 * m[1] * variance - m[1] ** 3) / variance**1.5,
        # The last term is 3 * centroid where the fourth central moment has 3 * centroid ** 4: as users know it.
        "kurtosis": NAN if flat else (m[4] - 4 * m[1] * m[3] + 6 * m[2] * m[1] ** 2 - 3 * m[1]) / variance**2,
    }
    return [values[p["aggtype"]] for p in params]


def welch(x: np.ndarray) -> np.ndarray:
    """One-sided Welch power density: periodic Hann windows of at most 256 points, half overlapping, means removed."""
    size = min(len(x), 256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    if size == 1:
        window = np.ones(1)
    step = max(1, size - size // 2)
    starts = range(0, len(x) - size + 1, step)
    total = np.zeros(size // 2 + 1)
    for s in starts:
        part = x[s : s + size]
        total += np.abs(np.fft.rfft((part - part.mean()) * window)) ** 2
    power = total / (len(starts) * (window**2).sum())
    power[1 : (-1 if size % 2 == 0 else None)] *= 2
    return power


@kernel
def spkt_welch_density(x, params):
    power = welch(x)
    return [float(power[p["coeff"]]) if p["coeff"] < len(power) else NAN for p in params]


def histogram_entropy(x: np.ndarray, bins: int) -> float:
    if np.isnan(x).any() or not len(x):
        return NAN
    counts, _ = np.histogram(x, bins=bins)
    p = counts[counts > 0] / len(x)
    return float(-(p * np.log(p)).sum())


@kernel
def fourier_entropy(x, params):
    power = welch(x)
    with np.errstate(all="ignore"):
        scaled = power / power.max()
    return [histogram_entropy(scaled, p["bins"]) for p in params]


# --- wavelets ---------------------------------------------------------------------------------------------------------


def mexican_hat_transform(x: np.ndarray, width: float, precision: int = 12) -> np.ndarray:
    """Continuous transform by the integrated wavelet: sampled on [-8, 8], stretched, convolved, differenced, centred."""
    grid = np.linspace(-8.0, 8.0, 2**precision)
    step = grid[1] - grid[0]
    psi = (1 - grid**2) * np.exp(-(grid**2) / 2) * 2 / (math.sqrt(3) * math.pi**0.25)
    integral = np.cumsum(psi) * step
    at = (np.arange(width * 16.0 + 1) / (width * step)).astype(int)
    filt = integral[at[at < len(integral)]][::-1]
    out = -math.sqrt(width) * np.diff(np.convolve(x, filt))
    extra = (len(out) - len(x)) / 2
    return out[math.floor(extra) : len(out) - math.ceil(extra)] if extra > 0 else out


@kernel
def cwt_coefficients(x, params):
    done: dict = {}
    out = []
    for p in params:
        w = p["w"]
        if w not in done:
            done[w] = mexican_hat_transform(x, w)
        out.append(float(done[w][p["coeff"]]) if p["coeff"] < len(done[w]) else NAN)
    return out


def ricker(points: int, a: float) -> np.ndarray:
    t = (np.arange(points) - (points - 1) / 2) / a
    return 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2)


def count_ridge_peaks(x: np.ndarray, widest: int) -> int:
    """Peaks as ridge lines of local maxima through the Ricker transforms of widths 1..widest that are long and clear enough."""
    n = len(x)
    widths = np.arange(1, widest + 1)
    rows = np.array([np.convolve(x, ricker(min(10 * w, n), w)[::-1], mode="same")[:n] for w in widths])
    is_top = np.zeros(rows.shape, bool)
    is_top[:, 1:-1] = (rows[:, 1:-1] > rows[:, :-2]) & (rows[:, 1:-1] > rows[:, 2:])
    with_tops = np.nonzero(is_top.any(axis=1))[0]
    if not len(with_tops):
        return 0
    gap, last = 1, with_tops[-1]
    open_ = [{"row": last, "col": c, "end": c, "len": 1, "gap": 0} for c in np.nonzero(is_top[last])[0]]
    done = []
    for r in range(last - 1, -1, -1):
        for line in open_:
            line["gap"] += 1
        ends = np.array([line["end"] for line in open_])
        for c in np.nonzero(is_top[r])[0]:
            near = int(np.argmin(np.abs(ends - c))) if len(ends) else -1
            if near >= 0 and abs(ends[near] - c) <= widths[r] / 4.0:
                open_[near] |= {"row": r, "col": c, "end": c, "len": open_[near]["len"] + 1, "gap": 0}
            else:
                open_.append({"row": r, "col": c, "end": c, "len": 1, "gap": 0})
        done += [line for line in open_ if line["gap"] > gap]
        open_ = [line for line in open_ if line["gap"] <= gap]
    half, odd = divmod(math.ceil(n / 20), 2)
    least = math.ceil(widest / 4)
    found = 0
    for line in done + open_:
        c = line["col"]
        noise = np.percentile(rows[0, max(c - half, 0) : min(c + half + odd, n)], 10)
        with np.errstate(all="ignore"):
            clear = abs(rows[line["row"], c] / noise)
        found += line["len"] >= least and not clear < 1
    return found


@kernel
def number_cwt_peaks(x, params):
    return [float(count_ridge_peaks(x, p["n"])) for p in params]


# --- models -----------------------------------------------------------------------------------------------------------


@kernel
def ar_coefficient(x, params):
    done: dict = {}
    out = []
    for p in params:
        k, coeff = int(p["k"]), int(p["coeff"])
        if k not in done:
            n = len(x)
            if n - k < k + 1 or n <= k:
                done[k] = None
            else:
                lags = np.column_stack([np.ones(n - k), *[x[k - j : n - j] for j in range(1, k + 1)]])
                done[k] = np.linalg.lstsq(lags, x[k:], rcond=None)[0]
        if coeff > k:
            out.append(NAN)
        elif done[k] is None:
            # A failed fit has no value for the constant and the lags before k, and 0 at k.
            out.append(0.0 if coeff == k else NAN)
        else:
            out.append(float(done[k][coeff]))
    return out


def _drift_polynomial(x: np.ndarray, m: int, r: int) -> np.ndarray:
    """Polynomial of degree m of the mean step on the mean level, over r quantile bins of the level; NaN where it has no fit."""
    level, step = x[:-1], np.diff(x)
    if len(level) < 2:
        return np.full(m + 1, NAN)
    edges = np.quantile(level, np.linspace(0, 1, r + 1))
    if len(np.unique(edges)) < len(edges):
        return np.full(m + 1, NAN)
    place = np.clip(np.searchsorted(edges, level, side="left"), 1, r)
    count = np.bincount(place, minlength=r + 1).astype(float)
    some = count > 0
    px, py = np.bincount(place, level, r + 1)[some] / count[some], np.bincount(place, step, r + 1)[some] / count[some]
    try:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return np.polyfit(px, py, m)
    except (np.linalg.LinAlgError, ValueError, TypeError):
        return np.full(m + 1, NAN)


@kernel
def friedrich_coefficients(x, params):
    done: dict = {}
    out = []
    for p in params:
        if p["coeff"] < 0:
            raise AssertionError("coefficients must be positive or zero")
        key = (p["m"], p["r"])
        if key not in done:
            done[key] = _drift_polynomial(x, *key)
        out.append(float(done[key][p["coeff"]]) if p["coeff"] < len(done[key]) else NAN)
    return out


@each
def max_langevin_fixed_point(x, r, m):
    poly = _drift_polynomial(x, m, r)
    if np.isnan(poly).any():
        return NAN
    try:
        roots = np.roots(poly)
    except (np.linalg.LinAlgError, ValueError):
        return NAN
    return float(np.max(np.real(roots))) if len(roots) else NAN


# --- entropies and complexities ---------------------------------------------------------------------------------------


def _matches(x: np.ndarray, m: int, templates: int, tolerance: float) -> np.ndarray:
    """For each template of length m, how many templates lie within the tolerance (maximum distance), itself included."""
    rows = np.lib.stride_tricks.sliding_window_view(x, m)[:templates]
    return np.array([(np.abs(rows - row).max(axis=1) <= tolerance).sum() for row in rows])


@each
def sample_entropy(x):
    n = len(x)
    if np.isnan(x).any() or n < 3:
        return NAN
    tolerance = 0.2 * np.std(x)
    b = _matches(x, 2, n - 1, tolerance).sum() - (n - 1)
    a = _matches(x, 3, n - 2, tolerance).sum() - (n - 2)
    with np.errstate(all="ignore"):
        return float(-np.log(np.float64(a) / np.float64(b)))


@each
def approximate_entropy(x, m, r):
    n = len(x)
    if r < 0:
        raise ValueError("r must be positive")
    if n <= m + 1:
        return 0.0
    tolerance = r * np.std(x)

    def phi(k: int) -> float:
        share = _matches(x, k, n - k + 1, tolerance) / (n - k + 1.0)
        return float(np.log(share).sum() / (n - k + 1.0))

    return abs(phi(m) - phi(m + 1))


@each
def lempel_ziv_complexity(x, bins):
    edges = np.linspace(x.min(), x.max(), bins + 1)[1:]
    text = np.searchsorted(edges, x, side="left").tolist()
    seen: set = set()
    phrase: tuple = ()
    for c in text:
        phrase = (*phrase, c)
        if phrase not in seen:
            seen.add(phrase)
            phrase = ()
    return len(seen) / len(x)


@each
def permutation_entropy(x, tau, dimension):
    if len(x) < dimension:
        return NAN
    windows = np.lib.stride_tricks.sliding_window_view(x, dimension)[::tau]
    ranks = np.argsort(np.argsort(windows, axis=1, kind="stable"), axis=1, kind="stable")
    code = ranks @ (dimension ** np.arange(dimension))
    _, counts = np.unique(code, return_counts=True)
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


# --- subsequences -----------------------------------------------------------------------------------------------------


def _normalised(rows: np.ndarray) -> np.ndarray:
    sd = rows.std(axis=-1, keepdims=True)
    return (rows - rows.mean(axis=-1, keepdims=True)) / np.where(sd > 1e-12, sd, np.inf)


@each
def query_similarity_count(x, query=None, threshold=0.0, normalize=True):
    q = np.atleast_1d(np.asarray(query if query is not None else [NAN], float))
    if len(q) < 3 or np.isnan(q).any() or len(x) < len(q):
        return NAN
    rows = np.lib.stride_tricks.sliding_window_view(x, len(q))
    if normalize:
        rows, q = _normalised(rows), _normalised(q)
    return float((np.sqrt(((rows - q) ** 2).sum(axis=1)) <= threshold).sum())


def profile(x: np.ndarray, window: int) -> np.ndarray:
    """Distance of each z-normalised subsequence to its nearest one outside a quarter window of itself."""
    rows = _normalised(np.lib.stride_tricks.sliding_window_view(x, window))
    n, near = len(rows), max(1, math.ceil(window / 4))
    out = np.full(n, np.inf)
    for i in range(n):
        corr = rows @ rows[i] / window
        corr[max(0, i - near) : i + near + 1] = -np.inf
        best = corr.max()
        if np.isfinite(best):
            out[i] = math.sqrt(max(0.0, 2 * window * (1 - best)))
    return out


@kernel
def matrix_profile(x, params):
    done: dict = {}
    out = []
    pick = {"min": np.min, "max": np.max, "mean": np.mean, "median": np.median, "25": lambda v: np.percentile(v, 25), "75": lambda v: np.percentile(v, 75)}
    for p in params:
        if p["feature"] not in pick:
            raise ValueError(f"unknown feature {p['feature']!r} of the matrix profile")
        given = p.get("windows")
        key = (str(given), p.get("threshold"))
        if key not in done:
            window = int(np.atleast_1d(given)[0]) if given is not None else None
            if window is None:
                # The longest window, doubling from 8, whose best pair still correlates at the threshold.
                found, size = None, 8
                while size <= len(x) // 2:
                    d = profile(x, size)
                    ok = np.isfinite(d).any() and 1 - np.min(d[np.isfinite(d)]) ** 2 / (2 * size) >= p.get("threshold", 0.98)
                    if found is None or ok:
                        found = d
                    if not ok:
                        break
                    size *= 2
                done[key] = found
            else:
                done[key] = profile(x, window) if window <= len(x) // 2 else None
        d = done[key]
        d = d[np.isfinite(d)] if d is not None else np.zeros(0)
        out.append(float(pick[p["feature"]](d)) if len(d) else NAN)
    return out
