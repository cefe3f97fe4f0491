"""Feature extraction: from series to a feature table, as one Spark plan with one scan and one shuffle on (id, kind)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import blocks, naming, settings
from chronofold.functions.kernels import KERNELS
from chronofold.functions.native import KEYS, NATIVE, Build
from chronofold.plans.container import Container, kinds_of, to_long
from chronofold.util import shuffle_partitions

Settings = Mapping[str | Callable, list[dict] | None]
Request = tuple[str | Callable, str, dict | None]

#: Options about processes and progress, which Spark has no use for.
SCHEDULING = {"n_jobs", "chunksize", "disable_progressbar", "show_warnings", "distributor", "profile", "profiling_filename", "profiling_sorting", "parallelization"}
#: Joins the names of the features in one literal.
_BETWEEN = "\x1f"


def _requests(chosen: Settings) -> list[Request]:
    """(calculator, name of the feature, parameters), in the order of the settings."""
    out = []
    for calc, sets in chosen.items():
        name = calc if isinstance(calc, str) else calc.__name__
        if isinstance(calc, str) and calc not in NATIVE and calc not in KERNELS:
            raise ValueError(f"unknown calculator {calc!r}")
        out += [(calc, naming.feature_name(name, p), p) for p in (sets if sets else [None])]
    return out


def _indexed(calc: str | Callable) -> bool:
    """Does a custom calculator ask for a pandas series?"""
    return callable(calc) and getattr(calc, "input", None) == "pd.Series"


def _call(calc: str | Callable, x: np.ndarray, index: object, sets: list[dict | None]) -> list[float | None]:
    """The results of one calculator for all its parameter sets.

    Custom calculators are called once a set; those whose ``fctype`` is "combiner" once, with all sets as ``param``, and give (key, value) pairs in
    the order of the sets. Those whose ``input`` is "pd.Series" get the values with their times as the index (or numbers, without times).
    """
    if isinstance(calc, str):
        return KERNELS[calc](x, sets)
    given = pd.Series(x, index=index) if _indexed(calc) else x
    if getattr(calc, "fctype", None) == "combiner":
        return [v for _, v in calc(given, param=[p or {} for p in sets])]
    return [float(calc(given, **(p or {}))) for p in sets]


def _kernel_column(series: Column, kind: Column, times: Column | None, calls: dict[str | Callable, list[tuple[int, dict | None, set[str] | None]]], matrices: bool) -> Column:
    """All calls of all series in one Arrow function: an array of results, NULL where a kind does not ask for it. A call is a place in the array, a parameter set and the kinds that ask for it.

    With ``matrices`` the series of one length in a batch are one matrix (their values must be finite).
    """
    size = sum(map(len, calls.values()))
    special = any(wanted is not None for sets in calls.values() for *_, wanted in sets)

    def run(arrays: pa.Array, kinds: pa.Array, stamps: pa.Array | None = None) -> pa.Array:
        plans: dict[str | None, list[tuple[str | Callable, list[int], list[dict | None]]]] = {}
        groups: dict[tuple[str | None, int], list[int]] = {}
        lengths = arrays.value_lengths().to_numpy()
        starts = np.cumsum(lengths) - lengths
        flat = arrays.flatten().to_numpy(zero_copy_only=False)
        for i, (k, n) in enumerate(zip(kinds.to_pylist() if special else [None] * len(arrays), lengths.tolist())):
            groups.setdefault((k, n), []).append(i)
        out = np.full((len(arrays), size), np.nan)
        for (k, n), members in groups.items():
            if k not in plans:
                plans[k] = []
                for calc, sets in calls.items():
                    if here := [(place, p) for place, p, wanted in sets if wanted is None or k in wanted]:
                        plans[k].append((calc, [place for place, _ in here], [p for _, p in here]))
            at = np.array(members)
            x = flat[starts[at][:, None] + np.arange(n)]
            if matrices and n:
                for part, b in blocks.blocks_of(x):
                    for calc, places, sets in plans[k]:
                        if isinstance(calc, str):
                            out[at[part][:, None], places] = blocks.values(calc, b, sets)
            with np.errstate(all="ignore"):
                for calc, places, sets in plans[k]:
                    if isinstance(calc, str) and matrices and n:
                        continue
                    for i, row in zip(members, x):
                        index = None if stamps is None else pd.to_datetime(stamps[i].values.to_numpy(zero_copy_only=False), unit="us", utc=True)
                        out[i, places] = [np.nan if v is None else v for v in _call(calc, row, index, sets)]
        results = out.ravel()
        return pa.ListArray.from_arrays(np.arange(len(arrays) + 1, dtype=np.int32) * size, pa.array(results, mask=np.isnan(results)))

    if times is None:

        @F.arrow_udf("array<double>")
        def kernels(arrays: pa.Array, kinds: pa.Array) -> pa.Array:
            return run(arrays, kinds)

        return kernels(series, kind)

    @F.arrow_udf("array<double>")
    def timed_kernels(arrays: pa.Array, kinds: pa.Array, stamps: pa.Array) -> pa.Array:
        return run(arrays, kinds, stamps)

    return timed_kernels(series, kind, times)


def _finite(long: DataFrame) -> bool:
    """One pass over the values: are all of them finite numbers?"""
    v = F.col("_v")
    return not long.isStreaming and not long.agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).collect()[0][0]


def _merged(default: Settings | None, per_kind: Mapping[str, Settings], timed: bool) -> tuple[list[Request], dict[str | None, list[int]]]:
    """All requests of all kinds, each once, and per kind the places of its own, in its settings' order; None stands for any other kind."""
    place: dict[tuple, int] = {}
    requests: list[Request] = []
    own: dict[str | None, list[int]] = {}
    for kind, chosen in [*([(None, default)] if default else []), *per_kind.items()]:
        own[kind] = []
        for r in _requests(chosen or {}):
            if not timed and r[0] in settings.TIMED:
                continue
            key = (r[0], r[1])
            if key not in place:
                place[key] = len(requests)
                requests.append(r)
            own[kind].append(place[key])
    return requests, own


def value_frame(long: DataFrame, requests: list[Request], own: Mapping[str | None, list[int]] | None = None) -> DataFrame:
    """(_id, _kind, values): one array per series with the requested features in order. Kernels run for the kinds that ask for them (``own``).

    If there are kernels, a series travels to them as an array; then what else can be had from finite values there is not built by Spark a second time.
    """
    build = Build()
    matrices = any(isinstance(calc, str) and calc in KERNELS for calc, *_ in requests) and _finite(long)
    native: dict[int, Column] = {}
    calls: dict[str | Callable, list[tuple[int, dict | None]]] = {}
    for i, (calc, _, params) in enumerate(requests):
        if isinstance(calc, str) and calc in NATIVE and not (matrices and calc in blocks.BLOCKS):
            native[i] = NATIVE[calc](build, **(params or {}))
        else:
            calls.setdefault(calc, []).append((i, params))
    times = None
    if calls:
        build.series()
        if "_ts" in long.columns and any(map(_indexed, calls)):
            times = build.times()
    rows = long
    if any(build.levels):
        # Said once, so that every window and the aggregate below use this one exchange. Kernels cost far more than the bytes they read, so their
        # partitions must not be coalesced by size.
        rows = rows.repartition(*([shuffle_partitions(rows.sparkSession)] if calls else []), *KEYS)
    for level in build.levels:
        if level:
            rows = rows.withColumns(level)
    if not build.aggs:
        build.n()
    groups = rows.groupBy(*KEYS).agg(*[c.alias(n) for n, c in build.aggs.items()])
    order = list(native)
    values = F.array(*native.values()).cast("array<double>") if native else None
    if calls:
        # A kind without settings of its own takes the default's; so only kinds with their own are told apart.
        special = {k for k in (own or {}) if k is not None}
        asks = {i: None if not special else {k for k in special if i in own[k]} for i in range(len(requests))}
        rest = special and None in (own or {})
        wanted = {c: [(p, asks[i]) for i, p in sets] for c, sets in calls.items()}
        if rest:
            # The default's own requests are asked for by every other kind: those are masked below, not skipped.
            default = set(own[None])
            wanted = {c: [(p, None if i in default else asks[i]) for i, p in sets] for c, sets in calls.items()}
        # Without Spark's expressions the calls' places are those of the requests; else they follow them.
        places = {i: k if native else i for k, i in enumerate(i for sets in calls.values() for i, _ in sets)}
        placed = {c: [(places[i], p, asked) for (i, _), (p, asked) in zip(calls[c], sets)] for c, sets in wanted.items()}
        groups = groups.withColumn("_kernels", _kernel_column(F.col("series"), F.col("_kind"), times, placed, matrices))
        values = F.concat(values, F.col("_kernels")) if native else F.col("_kernels")
        order += sorted(places, key=places.get)
    if order != list(range(len(requests))):
        back = {i: k for k, i in enumerate(order)}
        # One literal instead of a column per feature.
        places = F.split(F.lit(",".join(str(back[i]) for i in range(len(requests)))), ",").cast("array<int>")
        groups = groups.withColumn("_all", values)
        values = F.transform(places, lambda k: F.get(F.col("_all"), k))
    return groups.select(*KEYS, values.alias("values"))


def _of_kinds(long: DataFrame, own: Mapping[str | None, list[int]]) -> DataFrame:
    """The rows of the kinds that are asked for anything."""
    if None in own:
        nothing = [k for k, places in own.items() if k is not None and not places]
        return long.where(~F.col("_kind").isin(nothing)) if nothing else long
    return long.where(F.col("_kind").isin([k for k, places in own.items() if places]))


def _long_form(frame: DataFrame, requests: list[Request], own: Mapping[str | None, list[int]]) -> DataFrame:
    names = F.split(F.lit(_BETWEEN.join(name for _, name, _ in requests)), _BETWEEN)
    literal = lambda places: F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    special = [k for k in own if k is not None]
    if not special:
        pairs = F.arrays_zip(names.alias("name"), F.col("values").alias("value"))
    else:
        places = literal(own.get(None) or own[special[0]])
        for k in special:
            if own[k]:
                places = F.when(F.col("_kind") == k, literal(own[k])).otherwise(places)
        pairs = F.transform(places, lambda i: F.struct(F.get(names, i).alias("name"), F.get(F.col("values"), i).alias("value")))
    return frame.select(F.col("_id").alias("id"), "_kind", F.explode(pairs).alias("p")).select("id", F.concat_ws("__", "_kind", F.col("p.name")).alias("variable"), F.col("p.value").alias("value"))


def _plan(long: DataFrame, default: Settings | None, per_kind: Mapping[str, Settings] | None) -> tuple[DataFrame, list[Request], dict[str | None, list[int]]]:
    requests, own = _merged(default, per_kind or {}, "_ts" in long.columns)
    if not requests:
        raise ValueError("no calculators are asked for")
    return value_frame(_of_kinds(long, own), requests, own), requests, own


def extract_long(long: DataFrame, default: Settings | None, per_kind: Mapping[str, Settings] | None = None) -> DataFrame:
    """(id, variable, value) of every series in the canonical long frame. NULL: not defined for this series. All kinds share one scan."""
    return _long_form(*_plan(long, default, per_kind))


def extract_matrix(long: DataFrame, kinds: list[str], default: Settings | None, per_kind: Mapping[str, Settings] | None = None) -> DataFrame:
    """One row per id with the features of all ``kinds``.

    Series' features travel as one array to their id; a column is a place in a kind's array. So no row meets more than one condition per kind.
    """
    frame, requests, own = _plan(long, default, per_kind)
    wide = frame.groupBy(F.col("_id").alias("id")).agg(*[F.first(F.when(F.col("_kind") == k, F.col("values")), ignorenulls=True).alias(f"_k{j}") for j, k in enumerate(kinds)])
    tick = lambda name: "`" + name.replace("`", "``") + "`"
    columns = [f"_k{j}[{i}] AS {tick(k + '__' + requests[i][1])}" for j, k in enumerate(kinds) for i in own.get(k, own.get(None, []))]
    return wide.selectExpr("id", *columns)


def pivot_features(features: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """Rows (id, variable, value) as a matrix: id and one column per variable, in order. The list of variables is discovered if it is not given."""
    if variables is None:
        variables = sorted(r[0] for r in features.select("variable").distinct().collect())
    return features.groupBy("id").agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])


def extract_features(
    timeseries_container: Container,
    default_fc_parameters: Settings | None = None,
    kind_to_fc_parameters: Mapping[str, Settings] | None = None,
    column_id: str = "id",
    column_sort: str | list[str] | None = None,
    column_kind: str | None = None,
    column_value: str | None = None,
    column_time: str | None = None,
    impute_function: Callable[[DataFrame], DataFrame] | None = None,
    pivot: bool = True,
    validate: bool = True,
    kinds: list[str] | None = None,
    **scheduling: object,
) -> DataFrame:
    """Features of every series; the matrix (one row per id), or with ``pivot=False`` rows (id, variable, value).

    With neither settings given, all calculators run; with ``kind_to_fc_parameters`` alone, only the kinds it names. Settings about processes
    and progress are accepted and ignored: Spark schedules; any other option is an error. Features that need times run if ``column_time`` is given. The
    columns of a matrix depend on the kinds: those of a long frame are found by a scan of that column, unless ``kinds`` gives them.
    """
    if unknown := set(scheduling) - SCHEDULING:
        raise TypeError(f"unknown options: {sorted(unknown)}")
    if default_fc_parameters is None:
        default_fc_parameters = {} if kind_to_fc_parameters else settings.ComprehensiveFCParameters()
    long = to_long(timeseries_container, column_id, column_sort, column_kind, column_value, column_time, validate)
    if not pivot:
        return extract_long(long, default_fc_parameters, kind_to_fc_parameters)
    if kinds is None:
        kinds = kinds_of(timeseries_container, column_id, column_sort, column_kind, column_value, column_time)
    if kinds is None and not default_fc_parameters:
        kinds = sorted(kind_to_fc_parameters)
    if kinds is None:
        kinds = sorted(r[0] for r in long.select("_kind").distinct().collect() if r[0] is not None)
    matrix = extract_matrix(long, sorted(kinds), default_fc_parameters, kind_to_fc_parameters)
    return impute_function(matrix) if impute_function else matrix
