"""Calculators: known values, edges, and Spark expressions against plain numpy."""

import math

import numpy as np
import pytest

from chronofold.functions import blocks, naming, settings
from chronofold.functions.kernels import KERNELS, student_two_sided, welch
from chronofold.functions.native import NATIVE
from chronofold.plans.extract import extract_features

NAN = float("nan")


def k(name, x, **p):
    return KERNELS[name](np.asarray(x, float), [p])[0]


@pytest.mark.parametrize(
    "name,x,params,value",
    [
        # Phrases 0, 01, 1, and 01 again.
        ("lempel_ziv_complexity", [0, 0, 1, 1, 0, 1], {"bins": 2}, 3 / 6),
        # Up and down by turns: two patterns, equally often.
        ("permutation_entropy", [1, 3, 2, 4, 0], {"tau": 1, "dimension": 2}, math.log(2)),
        ("agg_autocorrelation", [0, 1, 0, 1], {"f_agg": "mean", "maxlag": 1}, -1.0),
        ("agg_autocorrelation", [2, 2, 2], {"f_agg": "mean", "maxlag": 2}, 0.0),
        ("partial_autocorrelation", [3, -3] * 4, {"lag": 1}, -1.0),
        # The spectrum of an impulse is flat: places 0 to 3.
        ("fft_aggregated", [1, 0, 0, 0, 0, 0], {"aggtype": "centroid"}, 1.5),
        ("fft_aggregated", [1, 0, 0, 0, 0, 0], {"aggtype": "variance"}, 1.25),
    ],
)
def test_values_by_hand(name, x, params, value):
    assert k(name, x, **params) == pytest.approx(value, abs=1e-9)


def _near(x, m, r, count):
    rows = [x[i : i + m] for i in range(count)]
    return [sum(max(abs(u - v) for u, v in zip(a, b)) <= r for b in rows) for a in rows]


def test_entropies_against_loops():
    x = [float((7 * i * i + 3 * i) % 11) for i in range(37)]
    n, r = len(x), 0.2 * float(np.std(x))
    pairs = [sum(_near(x, m, r, n - m + 1)) - (n - m + 1) for m in (2, 3)]
    assert k("sample_entropy", x) == pytest.approx(-math.log(pairs[1] / pairs[0]))
    r = 0.7 * float(np.std(x))
    phi = [sum(math.log(c / (n - m + 1)) for c in _near(x, m, r, n - m + 1)) / (n - m + 1) for m in (2, 3)]
    assert k("approximate_entropy", x, m=2, r=0.7) == pytest.approx(abs(phi[0] - phi[1]))


def test_kernels_on_short_series():
    for name, sets in settings.comprehensive().items():
        if name in KERNELS:
            for x in ([], [1.0], [1.0, 1.0], [1.0, 2.0], [3.0, 1.0, 2.0], np.ones(30)):
                if len(x):
                    got = KERNELS[name](np.asarray(x, float), sets or [{}])
                    assert len(got) == len(sets or [{}])


def test_autoregression_and_query_and_peaks():
    x = [1.0]
    for _ in range(9):
        x.append(2.5 * x[-1] + 1)
    assert k("ar_coefficient", x, coeff=0, k=1) == pytest.approx(1) and k("ar_coefficient", x, coeff=1, k=1) == pytest.approx(2.5)
    assert k("ar_coefficient", [1, 2], coeff=10, k=10) == 0 and math.isnan(k("ar_coefficient", [1, 2], coeff=3, k=10))
    assert math.isnan(k("query_similarity_count", [1, 2, 3], query=None, threshold=0.0))
    assert k("query_similarity_count", [1, 2, 3, 1, 2, 3, 4], query=[1, 2, 3], threshold=0.0, normalize=False) == 2
    two = np.ones(21)
    two[[7, 14]] = 5
    assert k("number_cwt_peaks", two, n=2) == 2


def test_unit_root():
    rng = np.random.default_rng(5)
    steps = rng.normal(size=800)
    walk, pull = np.cumsum(steps), np.zeros(800)
    for i in range(1, 800):
        pull[i] = 0.4 * pull[i - 1] + steps[i]
    assert k("augmented_dickey_fuller", walk, attr="pvalue", autolag="AIC") > 0.05
    assert k("augmented_dickey_fuller", pull, attr="pvalue", autolag="AIC") < 0.001
    assert k("partial_autocorrelation", pull, lag=1) == pytest.approx(0.4, abs=0.1) and abs(k("partial_autocorrelation", pull, lag=2)) < 0.1
    assert math.isnan(k("augmented_dickey_fuller", [3.0] * 12, attr="teststat", autolag="AIC"))
    assert math.isnan(k("augmented_dickey_fuller", [5.0], attr="usedlag", autolag="AIC"))


def test_spectrum_keeps_the_power():
    x = np.random.default_rng(0).normal(size=4096)
    assert welch(x).sum() / 256 == pytest.approx(x.var(), rel=0.1)
    assert student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


def brute(x):
    n, d, mean = len(x), np.diff(x), x.mean()
    t = np.arange(n)
    out = {
        "cid_ce__normalize_False": math.sqrt((d**2).sum()),
        "mean_abs_change": np.abs(d).mean() if n > 1 else None,
        "longest_strike_above_mean": max((len(s) for s in "".join("1" if v > mean else "0" for v in x).split("0"))),
        "number_peaks__n_1": sum(x[i] > x[i - 1] and x[i] > x[i + 1] for i in range(1, n - 1)),
        "last_location_of_maximum": (n - np.argmax(x[::-1])) / n,
        "first_location_of_minimum": np.argmin(x) / n,
        "count_above_mean": (x > mean).sum(),
        "c3__lag_1": np.mean([x[i + 2] * x[i + 1] * x[i] for i in range(n - 2)]) if n > 2 else 0.0,
        "quantile__q_0.1": np.quantile(x, 0.1),
        'linear_trend__attr_"slope"': np.polyfit(t, x, 1)[0] if n > 1 else None,
        "variance": x.var(),
        "sum_of_reoccurring_values": sum(v for v in set(x.tolist()) if (x == v).sum() > 1),
        "number_crossing_m__m_0": (np.diff(x > 0) != 0).sum() if n > 1 else 0,
        "mean_n_absolute_max__number_of_maxima_7": np.sort(np.abs(x))[-7:].mean() if n > 7 else None,
        'change_quantiles__f_agg_"mean"__isabs_True__qh_0.8__ql_0.2': None,
        "energy_ratio_by_chunks__num_segments_10__segment_focus_3": (np.array_split(x, 10)[3] ** 2).sum() / (x**2).sum() if (x**2).sum() else None,
    }
    lo, hi = np.quantile(x, [0.2, 0.8])
    inside = (x >= lo) & (x <= hi)
    steps = np.abs(d)[inside[:-1] & inside[1:]] if lo < hi else np.zeros(0)
    out['change_quantiles__f_agg_"mean"__isabs_True__qh_0.8__ql_0.2'] = steps.mean() if len(steps) else 0.0
    return out


def test_expressions_equal_numpy(spark):
    rng = np.random.default_rng(7)
    series = [rng.normal(size=n).round(1) for n in (1, 2, 3, 8, 9, 40, 123)] + [np.ones(12), np.zeros(4)]
    rows = [(i, "k", t, float(v)) for i, x in enumerate(series) for t, v in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(a), b, int(c), float(d)) for a, b, c, d in rows], "id long, kind string, t long, v double")
    names = {naming.parse_feature("k__" + n)[1] for n in brute(series[5])}
    chosen = {n: s for n, s in settings.comprehensive().items() if n in names}
    got = {(r["id"], r["variable"]): r["value"] for r in extract_features(df, chosen, column_id="id", column_sort="t", column_kind="kind", column_value="v", pivot=False).collect()}
    for i, x in enumerate(series):
        for n, v in brute(x).items():
            g = got[i, "k__" + n]
            assert (g is None) == (v is None), (i, n, g, v)
            if v is not None:
                assert g == pytest.approx(float(v), abs=1e-8), (i, n)


def test_matrices_equal_kernels():
    """Series of one length together give what each gives alone. Perfect lines are left out, whose fits leave nothing but rounding, and the peaks of a constant, which are rounding as well."""
    rng = np.random.default_rng(1)
    for n in [*range(1, 34), 60, 130, 300]:
        x = np.vstack([rng.gamma(1, 50, (5, n)).round(2), rng.normal(size=(3, n)).cumsum(axis=1), np.full((1, n), 0.1)])
        b = blocks.Block(x)
        for name, sets in settings.comprehensive().items():
            if name in KERNELS and name in blocks.BLOCKS:
                with np.errstate(all="ignore"):
                    want = np.array([[NAN if v is None else v for v in KERNELS[name](row, sets or [None])] for row in x], float)
                got = blocks.values(name, b, sets or [None])
                if name == "number_cwt_peaks":
                    got, want = got[:-1], want[:-1]
                np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-7, err_msg=f"{name} {n}")


def test_matrices_equal_expressions(spark):
    """With a kernel the rest is computed beside it, not by windows; with a value missing it is Spark's again."""
    rng = np.random.default_rng(3)
    series = [rng.normal(size=n).round(1) for n in (1, 2, 3, 4, 9, 14, 40)] + [np.ones(12), np.full(7, 0.1), rng.integers(-2, 3, 30)]
    rows = [(i, t, float(v)) for i, x in enumerate(series) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, t long, v double")
    chosen = {n: s[:6] if s and n != "change_quantiles" else s and s[::7] for n, s in settings.comprehensive().items() if n in NATIVE and n in blocks.BLOCKS}
    assert set(NATIVE) - set(blocks.BLOCKS) == {"linear_trend_timewise"}
    options = {"column_id": "id", "column_sort": "t", "column_value": "v", "pivot": False, "validate": False}
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    beside = extract_features(df, chosen | {"fft_aggregated": [{"aggtype": "centroid"}]}, **options)
    assert plan(beside).count("Window [") == 1
    got = {(r["id"], r["variable"]): r["value"] for r in beside.collect()}
    for r in extract_features(df, chosen, **options).collect():
        g, v = got[r["id"], r["variable"]], r["value"]
        assert (g is None) == (v is None) and (v is None or g == pytest.approx(v, rel=1e-9, abs=1e-9)), (r, g)
    odd = df.union(spark.createDataFrame([(0, 1, None), (0, 2, 5.0)], df.schema))
    few = {"length": None, "sum_values": None, "fft_aggregated": [{"aggtype": "centroid"}]}
    of_first = {r["variable"]: r["value"] for r in extract_features(odd, few, **options).where("id = 0").collect()}
    assert of_first["v__length"] == 2.0 and of_first["v__sum_values"] == pytest.approx(series[0][0] + 5.0)


def test_all_settings_on_the_smallest_series(spark):
    df = spark.createDataFrame([(1, "a", 1, 5.0), (2, "a", 1, 1.0), (2, "a", 2, 1.0)], "id long, kind string, sort long, val double")
    matrix = extract_features(df, column_id="id", column_sort="sort", column_kind="kind", column_value="val")
    assert matrix.count() == 2 and len(matrix.columns) == 1 + 794 - 5


def test_names_round_trip():
    for name, sets in settings.comprehensive().items():
        for p in sets or [None]:
            kind, calc, params = naming.parse_feature("k__" + naming.feature_name(name, p))
            assert (kind, calc, params) == ("k", name, p)
    with pytest.raises(TypeError):
        settings.from_columns([1])
    for bad in ("plain", "k__unknown"):
        with pytest.raises(ValueError):
            settings.from_columns([bad])
    assert settings.from_columns(["a__mean", "a__quantile__q_0.1", "skip"], ["skip"]) == {"a": {"mean": None, "quantile": [{"q": 0.1}]}}


def test_counts_of_settings():
    total = lambda s: sum(len(v or [0]) for v in s.values())
    assert (len(settings.NAMES), total(settings.ComprehensiveFCParameters())) == (76, 794)
    assert len(settings.MinimalFCParameters()) == 10 and len(settings.EfficientFCParameters()) == 74
    assert set(settings.IndexBasedFCParameters()) == set(settings.INDEXED) and list(settings.TimeBasedFCParameters()) == ["linear_trend_timewise"]
