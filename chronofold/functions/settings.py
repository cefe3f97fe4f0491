"""Which calculators run, with which parameters: dictionaries of calculator -> None or a list of parameter sets."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from chronofold.functions import naming

#: The calculators, by what their settings need.
PLAIN = (
    "variance_larger_than_standard_deviation", "has_duplicate_max", "has_duplicate_min", "has_duplicate", "sum_values", "abs_energy", "mean_abs_change", "mean_change",
    "mean_second_derivative_central", "median", "mean", "length", "standard_deviation", "variation_coefficient", "variance", "skewness", "kurtosis", "root_mean_square",
    "absolute_sum_of_changes", "longest_strike_below_mean", "longest_strike_above_mean", "count_above_mean", "count_below_mean", "last_location_of_maximum",
    "first_location_of_maximum", "last_location_of_minimum", "first_location_of_minimum", "percentage_of_reoccurring_values_to_all_values",
    "percentage_of_reoccurring_datapoints_to_all_datapoints", "sum_of_reoccurring_values", "sum_of_reoccurring_data_points", "ratio_value_number_to_time_series_length",
    "sample_entropy", "maximum", "absolute_maximum", "minimum", "benford_correlation",
)
MINIMAL = ("sum_values", "median", "mean", "length", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum")
EXPENSIVE = ("sample_entropy", "approximate_entropy")
INDEXED = ("skewness", "kurtosis", "percentage_of_reoccurring_datapoints_to_all_datapoints", "linear_trend_timewise")
TIMED = ("linear_trend_timewise",)


def _grid(**axes: Iterable) -> list[dict]:
    return [dict(zip(axes, values)) for values in product(*axes.values())]


TREND = ("pvalue", "rvalue", "intercept", "slope", "stderr")
TENTHS = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
WIDTHS = (2, 5, 10, 20)
BINS = (2, 3, 5, 10, 100)


def comprehensive() -> dict[str, list[dict] | None]:
    """Every calculator with its default parameters (fixed values)."""
    out: dict[str, list[dict] | None] = {name: None for name in PLAIN}
    out |= {
        "time_reversal_asymmetry_statistic": _grid(lag=range(1, 4)),
        "c3": _grid(lag=range(1, 4)),
        "cid_ce": _grid(normalize=(True, False)),
        "symmetry_looking": [{"r": k * 0.05} for k in range(20)],
        "large_standard_deviation": [{"r": k * 0.05} for k in range(1, 20)],
        "quantile": _grid(q=TENTHS),
        "autocorrelation": _grid(lag=range(10)),
        "agg_autocorrelation": _grid(f_agg=("mean", "median", "var"), maxlag=(40,)),
        "partial_autocorrelation": _grid(lag=range(10)),
        "number_cwt_peaks": _grid(n=(1, 5)),
        "number_peaks": _grid(n=(1, 3, 5, 10, 50)),
        "binned_entropy": _grid(max_bins=(10,)),
        "index_mass_quantile": _grid(q=TENTHS),
        "cwt_coefficients": [{"widths": WIDTHS, "coeff": c, "w": w} for c in range(15) for w in WIDTHS],
        "spkt_welch_density": _grid(coeff=(2, 5, 8)),
        "ar_coefficient": _grid(coeff=range(11), k=(10,)),
        "change_quantiles": [{"ql": a, "qh": b, "isabs": i, "f_agg": f} for a in (0.0, 0.2, 0.4, 0.6, 0.8) for b in (0.2, 0.4, 0.6, 0.8, 1.0) if a < b for i in (False, True) for f in ("mean", "var")],
        "fft_coefficient": _grid(attr=("real", "imag", "abs", "angle"), coeff=range(100)),
        "fft_aggregated": _grid(aggtype=("centroid", "variance", "skew", "kurtosis")),
        "value_count": _grid(value=(0, 1, -1)),
        "range_count": [{"min": -1, "max": 1}, {"min": -1e12, "max": 0}, {"min": 0, "max": 1e12}],
        "approximate_entropy": _grid(m=(2,), r=(0.1, 0.3, 0.5, 0.7, 0.9)),
        "friedrich_coefficients": _grid(coeff=range(4), m=(3,), r=(30,)),
        "max_langevin_fixed_point": _grid(m=(3,), r=(30,)),
        "linear_trend": _grid(attr=TREND),
        "agg_linear_trend": _grid(attr=TREND[1:], chunk_len=(5, 10, 50), f_agg=("max", "min", "mean", "var")),
        "augmented_dickey_fuller": [{"attr": a} | {"autolag": "AIC"} for a in ("teststat", "pvalue", "usedlag")],
        "number_crossing_m": _grid(m=(0, -1, 1)),
        "energy_ratio_by_chunks": _grid(num_segments=(10,), segment_focus=range(10)),
        "ratio_beyond_r_sigma": _grid(r=(0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)),
        "linear_trend_timewise": _grid(attr=TREND),
        "count_above": _grid(t=(0,)),
        "count_below": _grid(t=(0,)),
        "lempel_ziv_complexity": _grid(bins=BINS),
        "fourier_entropy": _grid(bins=BINS),
        "permutation_entropy": _grid(tau=(1,), dimension=range(3, 8)),
        "query_similarity_count": [{"query": None, "threshold": 0.0}],
        "matrix_profile": _grid(threshold=(0.98,), feature=("min", "max", "mean", "median", "25", "75")),
        "mean_n_absolute_max": _grid(number_of_maxima=(7,)),
    }
    return out


NAMES = tuple(comprehensive())


#: Marks of calculators, for ``include_function``.
MARKS = {"high_comp_cost": EXPENSIVE, "minimal": MINIMAL, "input": INDEXED, "index_type": TIMED}


def include_function(calculator: str, exclusion_mark: str | None = None) -> bool:
    """Is this the name of a calculator that does not carry the mark (high_comp_cost, minimal, input, index_type)?"""
    if exclusion_mark is not None and exclusion_mark not in MARKS:
        raise ValueError(f"unknown mark {exclusion_mark!r}")
    return calculator in NAMES and (exclusion_mark is None or calculator not in MARKS[exclusion_mark])


class Settings(dict):
    """Settings that started from the comprehensive ones, kept for some calculators only."""

    def __init__(self, keep: Iterable[str] | None = None) -> None:
        chosen = None if keep is None else set(keep)
        super().__init__({k: v for k, v in comprehensive().items() if chosen is None or k in chosen})


class ComprehensiveFCParameters(Settings):
    """Everything."""


class MinimalFCParameters(Settings):
    """The ten basic statistics."""

    def __init__(self) -> None:
        super().__init__(MINIMAL)


class EfficientFCParameters(Settings):
    """Everything but the calculators that are quadratic in the length."""

    def __init__(self) -> None:
        super().__init__(set(NAMES) - set(EXPENSIVE))


class IndexBasedFCParameters(Settings):
    """Calculators that work on an indexed series."""

    def __init__(self) -> None:
        super().__init__(INDEXED)


class TimeBasedFCParameters(Settings):
    """Calculators that need times."""

    def __init__(self) -> None:
        super().__init__(TIMED)


def from_columns(columns: Iterable[str], columns_to_ignore: Iterable[str] = ()) -> dict[str, dict[str, list[dict] | None]]:
    """The settings per kind that give the named features."""
    ignore, out = set(columns_to_ignore), {}
    for c in columns:
        if c in ignore:
            continue
        kind, name, params = naming.parse_feature(c)
        if name not in NAMES:
            raise ValueError(f"unknown calculator {name!r} in {c!r}")
        if params is None:
            out.setdefault(kind, {})[name] = None
        else:
            got = out.setdefault(kind, {}).setdefault(name, [])
            if params not in got:
                got.append(params)
    return out
