"""Readings that cannot be trusted: spikes, stuck values and physically impossible values, per source."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.operators.spread import halo_chunks, salted_join
from chronofold.util import checkpointed, micros, usable

#: Longest excursion that counts as a spike, shortest run that counts as stuck; the halo covers both.
EXCURSION = 3
STUCK = 10
HALO = STUCK + 2
#: An excursion's size over the source's usual change: sizes between the two sides of the statement's "about ten times".
SIZE = 9.0
#: An excursion returns: it is at least this many times as large as the step from the reading before it to the one after.
RETURN = 2.0
#: A source "hardly ever repeats" if at most this share of its runs of equal readings has more than one reading.
REPEATS = 0.15

#: The forest: trees, and the rows of a tree to which all rows of a source are scaled (a node of a share 1 / GROWN_ON of them is one row).
TREES, GROWN_ON = 32, 256
#: Rows of a source that one task takes; a source with more is cut into slices. The result does not depend on it.
SLICE = 32768
#: Features are multiples of the source's own usual figures, and tell no more beyond this multiple.
TOP = 20.0
#: Two anchors (a typical reading moved to TOP in level and difference, and one moved to TOP in run length) are put into a tree's rows, so often each.
ANCHORS = 2
#: A reading is a candidate if its score lies this far from the source's median score towards its anchors' score.
TOWARDS = 0.35
#: Medians of features and of scores are taken in steps of 1 / these, so that counting each step gives them over any number of rows.
STEPS, SCORE_STEPS = 100, 10_000
#: Pairs of tree and row that are handled at once.
BLOCK = 1 << 18
#: Up to so many values a sketch of accuracy 10,000 is exact; a larger source's usual change is found by counting.
SKETCHED = 5_000
FEATURES = ["_x0", "_x1", "_x2", "_x3"]


def _extra(n: np.ndarray | float) -> np.ndarray:
    """Expected further path length in a node of n rows (Liu, Ting and Zhou 2008); between 1 and 3 rows in a straight line, as n need not be whole."""
    n = np.asarray(n, float)
    h = lambda k: 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k
    return np.where(n >= 3, h(np.maximum(n, 3.0)), np.interp(n, [1.0, 2.0, 3.0], [0.0, 1.0, float(h(3.0))]))


class IsolationForest:
    """Isolation trees grown on every row, level by level, all trees at once, in heap layout.

    A tree's height and its nodes' sizes are those of a tree of ``grown_on`` rows: n rows count as that many. So rare rows end alone however many
    rows there are, and no row is left out. A level needs the ranges and counts of its nodes only, which merge over any slices of the rows:
    a forest may be grown with ``planted`` and, for each level, ``ranges`` of all slices and one ``split``.
    """

    def __init__(self, x: np.ndarray, seed: int, trees: int = TREES, grown_on: int = GROWN_ON, counts: np.ndarray | None = None) -> None:
        counts = np.ones(len(x)) if counts is None else counts
        self._plant(float(counts.sum()), seed, trees, grown_on)
        at = np.zeros((trees, len(x)), np.int32)
        for level in range(self.depth + 1):
            self.split(level, *self.ranges(level, x, counts, at))
            at = self._down(x, at)

    @classmethod
    def planted(cls, total: float, seed: int, trees: int = TREES, grown_on: int = GROWN_ON) -> IsolationForest:
        """A forest for ``total`` rows that has not grown yet."""
        forest = cls.__new__(cls)
        forest._plant(total, seed, trees, grown_on)
        return forest

    def _plant(self, total: float, seed: int, trees: int, grown_on: int) -> None:
        self.seed, self.total, self.grown_on = seed, total, min(grown_on, total)
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.grown_on)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.cut = np.zeros((trees, nodes))
        self.size = np.zeros((trees, nodes))

    def _down(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes one level below; rows in leaves stay."""
        feature = np.take_along_axis(self.feature, at, 1)
        value = x[np.arange(len(x))[None, :], np.maximum(feature, 0)]
        return np.where(feature >= 0, 2 * at + 1 + (value >= np.take_along_axis(self.cut, at, 1)), at).astype(np.int32)

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node in each tree, so many levels down."""
        at = np.zeros((len(self.feature), len(x)), np.int32)
        for _ in range(levels):
            at = self._down(x, at)
        return at

    def ranges(self, level: int, x: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes of a level that hold any of these rows: place (tree by tree), count, and each feature's least and greatest value."""
        width, p = 2**level, x.shape[1]
        columns = [np.ascontiguousarray(x[:, j]) for j in range(p)]
        block = max(1, BLOCK // max(1, len(x)))
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, p)), np.zeros((0, p)))]
        for first in range(0, len(at), block):
            tree, row = np.nonzero(at[first : first + block] >= width - 1)
            if not len(row):
                continue
            place = tree * width + at[first + tree, row] - (width - 1)
            # Rows of one node lie together, so that a node's ranges are reductions over a slice.
            order = np.argsort(place.astype(np.min_scalar_type(int(place.max()))), kind="stable")
            place, row = place[order], row[order]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            sorted_ = [c[row] for c in columns]
            lo, hi = (np.column_stack([f.reduceat(c, starts) for c in sorted_]) for f in (np.minimum, np.maximum))
            parts.append((place[starts] + first * width, np.add.reduceat(counts[row], starts), lo, hi))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def split(self, level: int, place: np.ndarray, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Set the sizes of a level's nodes and split those that can be, given the ranges of all rows."""
        if level > self.depth:
            return
        width = 2**level
        tree, node = place // width, place % width + width - 1
        self.size[tree, node] = counts
        if level == self.depth:
            return
        # The draws belong to the nodes and do not depend on which of them are in use.
        p = lo.shape[1]
        draws = np.random.default_rng([self.seed, level]).random((len(self.feature) * width, p + 1))[place]
        # A random feature among those that vary in the node; nodes where none varies, and those of one row, stay leaves.
        span = hi - lo
        pick = np.argmax(np.where(span > 0, draws[:, :p], -1.0), axis=1)
        k = np.arange(len(place))
        splits = (span[k, pick] > 0) & (counts * self.grown_on > self.total)
        self.feature[tree[splits], node[splits]] = pick[splits]
        self.cut[tree, node] = lo[k, pick] + span[k, pick] * draws[:, p]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path) of each row; 0.5 if there was one row to grow on."""
        if self.grown_on < 2:
            return np.full(len(x), 0.5)
        trees, nodes = self.size.shape
        path = np.floor(np.log2(np.arange(nodes) + 1))[None, :] + _extra(self.size * (self.grown_on / self.total))
        out = np.empty(len(x))
        step = max(1, BLOCK // (4 * trees))
        for i in range(0, len(x), step):
            paths = np.take_along_axis(path, self.nodes(x[i : i + step], self.depth), 1)
            # Summed tree by tree, so that a score does not depend on the rows beside it.
            out[i : i + step] = np.add.accumulate(paths, axis=0)[-1]
        return 2.0 ** -(out / trees / float(_extra(self.grown_on)))


def _anchors(typical: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two anchors of a source of n rows to grow on, and how often each counts."""
    spike, stuck = typical.copy(), typical.copy()
    spike[:2], stuck[3] = TOP, TOP
    return np.array([spike, stuck]), np.full(2, float(max(1, ANCHORS * n // GROWN_ON)))


def _score_source(rows: pa.Table) -> pa.Table:
    """Score the readings of one source.

    Features are level, difference, season and run length. The forest grows on all runs of the source and the two anchors. The threshold is fitted
    on the source's own scores: TOWARDS of the way from the median score of all its runs to the lower score of the anchors. In a source
    full of spikes the anchors are less isolated, and the threshold sinks with them.
    """
    x = np.column_stack([rows.column(c).to_numpy() for c in FEATURES])
    grows = rows.column("_grows").to_numpy(zero_copy_only=False)
    runs = x[grows]
    anchors, copies = _anchors(np.median(np.rint(runs * STEPS), axis=0) / STEPS, len(runs))
    forest = IsolationForest(np.vstack([runs, anchors]), rows.column("_seed")[0].as_py(), counts=np.concatenate([np.ones(len(runs)), copies]))
    score = forest.score(x)
    usual, far = np.median(np.rint(score[grows] * SCORE_STEPS)) / SCORE_STEPS, forest.score(anchors).min()
    threshold = np.full(len(rows), usual + TOWARDS * max(far - usual, 0.0))
    keep = rows.select([c for c in rows.column_names if c not in (*FEATURES, "_grows", "_n", "_seed")])
    return keep.append_column("score", pa.array(score, pa.float64())).append_column("threshold", pa.array(threshold, pa.float64()))


def _plant(sources: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of each sliced source before it grows, and its anchors."""
    for batch in sources:
        states = []
        for r in batch.to_pylist():
            anchors, copies = _anchors(np.array([r[f"{c}_median"] for c in FEATURES]) / STEPS, r["_m"])
            states.append(pickle.dumps((IsolationForest.planted(float(r["_m"] + copies.sum()), r["_seed"]), anchors, copies)))
        yield pa.RecordBatch.from_arrays([batch.column("_s"), batch.column("_n"), pa.array(states, pa.binary())], ["_s", "_n", "_forest"])


def _slice_ranges(level: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def ranges(key: tuple, rows: pa.Table, forests: pa.Table) -> pa.Table:
        forest, anchors, copies = pickle.loads(forests.column("_forest")[0].as_py())
        x, counts = np.column_stack([rows.column(c).to_numpy() for c in FEATURES]), np.ones(len(rows))
        if key[1].as_py() == 0:
            x, counts = np.vstack([x, anchors]), np.concatenate([counts, copies])
        place, counts, lo, hi = forest.ranges(level, x, counts, forest.nodes(x, level))
        named = {f"_lo{j}": lo[:, j] for j in range(len(FEATURES))} | {f"_hi{j}": hi[:, j] for j in range(len(FEATURES))}
        return pa.table({"_s": pa.array([key[0].as_py()] * len(place), key[0].type), "_place": place, "_count": counts, **named})

    return ranges


def _grow(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def grow(ranges: pa.Table, forests: pa.Table) -> pa.Table:
        forest, anchors, copies = pickle.loads(forests.column("_forest")[0].as_py())
        lo, hi = (np.column_stack([ranges.column(f"_{side}{j}").to_numpy() for j in range(len(FEATURES))]) for side in ("lo", "hi"))
        forest.split(level, ranges.column("_place").to_numpy(), ranges.column("_count").to_numpy(), lo, hi)
        return forests.select(["_s", "_n"]).append_column("_forest", pa.array([pickle.dumps((forest, anchors, copies))], pa.binary()))

    return grow


def _score_slice(rows: pa.Table, forests: pa.Table) -> pa.Table:
    forest, anchors, _ = pickle.loads(forests.column("_forest")[0].as_py())
    score = forest.score(np.column_stack([rows.column(c).to_numpy() for c in FEATURES]))
    keep = rows.select([c for c in rows.column_names if c not in (*FEATURES, "_n", "_seed", "_slice")])
    return keep.append_column("score", pa.array(score, pa.float64())).append_column("_far", pa.array(np.full(len(rows), forest.score(anchors).min()), pa.float64()))


def _sliced_scores(rows: DataFrame) -> DataFrame:
    """``_score_source`` for sources of any size: slices of about SLICE rows give the ranges of the nodes, level by level; the same forest, the same scores."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    slices = F.ceil(F.col("_n") / SLICE).cast("int")
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_r"), slices).cast("int"))
    medians = [F.percentile(F.when(F.col("_grows"), F.rint(F.col(c) * STEPS)), 0.5).alias(f"{c}_median") for c in FEATURES]
    sources = rows.groupBy("_s").agg(F.max("_n").alias("_n"), F.max("_seed").alias("_seed"), F.count_if("_grows").alias("_m"), *medians)
    state = f"_s {fields['_s']}, _n {fields['_n']}, _forest binary"
    forests = checkpointed(sources.mapInArrow(_plant, state))
    bounds = [f"_{side}{j}" for side in ("lo", "hi") for j in range(len(FEATURES))]
    of_slices = lambda: forests.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).groupBy("_s", "_slice")
    runs = rows.where("_grows").select("_s", "_slice", *FEATURES).groupBy("_s", "_slice")
    for level in range(int(np.ceil(np.log2(GROWN_ON))) + 1):
        ranges = runs.cogroup(of_slices()).applyInArrow(_slice_ranges(level), f"_s {fields['_s']}, _place bigint, _count double, " + ", ".join(f"{b} double" for b in bounds))
        merged = ranges.groupBy("_s", "_place").agg(F.sum("_count").alias("_count"), *[(F.min if b.startswith("_lo") else F.max)(b).alias(b) for b in bounds])
        forests = checkpointed(merged.groupBy("_s").cogroup(forests.groupBy("_s")).applyInArrow(_grow(level), state))
    kept = ", ".join(f"`{c}` {t}" for c, t in fields.items() if c not in (*FEATURES, "_n", "_seed"))
    scored = checkpointed(rows.groupBy("_s", "_slice").cogroup(of_slices()).applyInArrow(_score_slice, f"{kept}, score double, _far double"))
    usual = F.percentile(F.when(F.col("_grows"), F.rint(F.col("score") * SCORE_STEPS)), 0.5) / SCORE_STEPS
    fitted = scored.groupBy("_s").agg(usual.alias("_usual"), F.max("_far").alias("_far"), F.count(F.lit(1)).alias("_n"))
    fitted = fitted.select("_s", "_n", (F.col("_usual") + TOWARDS * F.greatest(F.col("_far") - F.col("_usual"), F.lit(0.0))).alias("threshold"))
    return salted_join(scored.drop("_grows", "_far"), fitted, ["_s"], "_n", ["_r"]).drop("_n")


def forest_scores(features: DataFrame) -> DataFrame:
    """The features' rows with ``score`` and ``threshold``, from an isolation forest per source; the columns that only serve the forest are dropped.

    Needs ``_r`` (unique, BIGINT), ``_s``, the source's number of rows ``_n``, ``_starts`` (grow on this row?) and the features. A forest grows on
    every row that starts a run, and its threshold is fitted on the scores of all of them. A source of up to SLICE rows is one task's work, after one
    shuffle; larger ones are cut into slices that go to different tasks.
    """
    rows = features.select(
        *[c for c in features.columns if not c.startswith("f_") and c not in ("_n", "_starts")],
        *[F.col(c).cast("double").alias(x) for x, c in zip(FEATURES, ["f_level", "f_difference", "f_season", "f_run"])],
        F.col("_starts").alias("_grows"),
        "_n",
        F.xxhash64(F.col("_s")).bitwiseAND(F.lit(0x7FFFFFFF)).alias("_seed"),
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in (*FEATURES, "_grows", "_n", "_seed"))
    whole = rows.where(F.col("_n") <= SLICE).groupBy("_s").applyInArrow(_score_source, f"{kept}, score double, threshold double")
    large = rows.where(F.col("_n") > SLICE)
    return whole if large.isEmpty() else whole.unionByName(_sliced_scores(large))


def _exact_usual(rows: DataFrame, normal: DataFrame) -> DataFrame:
    """``normal`` with the exact ``_usual`` (lower median of the non-zero changes) for large sources too: only the values around the sketched one are told apart."""
    large = normal.where(F.col("_moves") > SKETCHED).select("_s", "_n", "_moves", "_around")
    if large.isEmpty():
        return normal
    low, high = F.col("_around")[0], F.col("_around")[1]
    steps = salted_join(rows.where("_step > 0").select("_r", "_s", "_step"), large, ["_s"], "_n", ["_r"], "inner").where(F.col("_step") <= high)
    counts = steps.groupBy("_s", F.when(F.col("_step") >= low, F.col("_step")).alias("_at")).agg(F.count(F.lit(1)).alias("_count"), F.max("_moves").alias("_moves"))
    upto = F.sum("_count").over(Window.partitionBy("_s").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    exact = counts.withColumn("_upto", upto).where(F.col("_at").isNotNull() & (F.col("_upto") * 2 >= F.col("_moves"))).groupBy("_s").agg(F.min("_at").alias("_exact"))
    return normal.join(exact, "_s", "left").withColumn("_usual", F.coalesce("_exact", "_usual")).drop("_exact")


def reading_features(
    readings: DataFrame, sources: DataFrame, reading: str = "reading_id", source: str = "id", time: str = "time", value: str = "value", low: str = "lo", high: str = "hi"
) -> DataFrame:
    """Per usable reading (see ``flag_readings``): its place in its source's course, and the figures the checks need."""
    good = readings.where(F.col(reading).isNotNull() & F.col(source).isNotNull() & F.col(time).isNotNull() & usable(F.col(value).cast("double")))
    once = good.groupBy(F.col(reading).alias("_r")).agg(F.min(F.struct(F.col(source).alias("_s"), micros(F.col(time)).alias("_t"), F.col(value).cast("double").alias("_v"))).alias("x")).select("_r", "x.*")
    cut = halo_chunks(once, "_s", ["_t", "_r"], HALO, "_chunk", "_core")
    w = Window.partitionBy("_s", "_chunk").orderBy("_t", "_r")
    v = F.col("_v")
    for k in range(1, EXCURSION + 1):
        cut = cut.withColumn(f"_b{k}", F.lag("_v", k).over(w)).withColumn(f"_a{k}", F.lead("_v", k).over(w))
    # The local level is the median of the seven readings around: an excursion holds three of them at most.
    around = F.sort_array(F.array_compact(F.array("_v", *[f"_{side}{k}" for side in "ab" for k in range(1, EXCURSION + 1)])))
    cut = cut.withColumn("_local", F.element_at(around, F.ceil(F.size(around) / 2).cast("int"))).withColumn(
        "_run", F.sum(F.when(F.col("_b1").isNull() | (v != F.col("_b1")), 1).otherwise(0)).over(w)
    )
    run = Window.partitionBy("_s", "_chunk", "_run")
    cut = cut.withColumn("_length", F.count(F.lit(1)).over(run)).where("_core")
    near = {0: v} | {-k: F.col(f"_b{k}") for k in range(1, EXCURSION + 1)} | {k: F.col(f"_a{k}") for k in range(1, EXCURSION + 1)}
    sizes, steps = [], []
    for length in range(1, EXCURSION + 1):
        for j in range(length):  # the reading is number j of the excursion
            p, q = near[-j - 1], near[length - j]
            block = [near[i] for i in range(-j, length - j)]
            far = [F.least(F.abs(b - p), F.abs(b - q)) for b in block]
            least = F.least(*far) if len(far) > 1 else far[0]
            # All members lie on one side of both neighbours.
            above = [(b > p) & (b > q) for b in block]
            below = [(b < p) & (b < q) for b in block]
            side = _all(above) | _all(below)
            ok = p.isNotNull() & q.isNotNull() & side & (least > RETURN * F.abs(q - p))
            sizes.append(F.when(ok, least).otherwise(F.lit(0.0)))
            steps.append(F.abs(q - p))
    size = F.greatest(*sizes)
    step = F.abs(v - F.col("_b1"))
    step = F.when(v == F.col("_b1"), F.lit(0.0)).otherwise(step)
    rows = checkpointed(cut.select("_r", "_s", "_t", "_v", "_local", "_length", size.alias("_size"), step.alias("_step"), F.abs(v - F.col("_a1")).alias("_ahead"), F.coalesce(step != 0, F.lit(True)).alias("_starts")))
    hour = F.floor(F.pmod(F.col("_t"), F.lit(86_400_000_000)) / 3_600_000_000).cast("int")
    # Sketches and sums per source and hour: mergeable states, combined before the shuffle.
    normal = rows.groupBy("_s").agg(
        F.percentile_approx(F.when(F.col("_step") > 0, F.col("_step")), [0.499, 0.5, 0.501], 10000).alias("_middle"),
        F.count_if(F.col("_step") > 0).alias("_moves"),
        F.percentile_approx("_v", [0.25, 0.75], 10000).alias("_quart"),
        F.count_if(F.col("_starts") & (F.col("_length") > 1)).alias("_same"),
        F.percentile_approx(F.when(F.col("_starts"), F.col("_length") - 1), 0.9, 10000).alias("_often"),
        F.count_if("_starts").alias("_g"),
        F.count(F.lit(1)).alias("_n"),
    )
    middle = F.col("_middle")
    normal = checkpointed(normal.withColumns({"_usual": middle[1], "_around": F.array(middle[0], middle[2])}).drop("_middle"))
    normal = _exact_usual(rows, normal).drop("_moves", "_around")
    season = rows.groupBy("_s", hour.alias("_hour")).agg(F.percentile_approx("_v", 0.5, 1000).alias("_season"))
    season = season.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct("_hour", "_season"))).alias("_seasons"))
    limits = sources.groupBy(F.col(source).alias("_s")).agg(F.max(low).alias("_lo"), F.min(high).alias("_hi"))
    per_source = normal.join(season, "_s").join(limits, "_s", "left")
    full = salted_join(rows, per_source, ["_s"], "_n", ["_r"])
    spread = F.greatest(F.col("_usual"), F.col("_quart")[1] - F.col("_quart")[0])
    ratio = lambda a, b: F.coalesce(F.least(F.try_divide(F.abs(a), b), F.lit(TOP)), F.lit(0.0))
    return full.select(
        "_r",
        "_s",
        F.coalesce((v < F.col("_lo")) | (v > F.col("_hi")), F.lit(False)).alias("impossible"),
        F.col("_length").alias("run_length"),
        F.coalesce(F.try_divide("_size", "_usual"), F.lit(0.0)).alias("size"),
        F.coalesce(F.try_divide("_same", "_g"), F.lit(0.0)).alias("repeats"),
        ratio(v - F.col("_local"), F.col("_usual")).alias("f_level"),
        ratio(F.greatest("_size", F.least("_step", "_ahead")), F.col("_usual")).alias("f_difference"),
        ratio(v - F.element_at("_seasons", hour), spread).alias("f_season"),
        ratio(F.col("_length") - 1, F.lit(1.0) + F.col("_often")).alias("f_run"),
        "_starts",
        "_n",
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def flag_readings(readings: DataFrame, sources: DataFrame, reading: str = "reading_id", source: str = "id", time: str = "time", value: str = "value", low: str = "lo", high: str = "hi") -> DataFrame:
    """Score every usable reading and flag the implausible ones of each source.

    Usable readings have an id, a source, a time and a value that is neither NULL nor NaN (infinite values are readings, beyond
    any limit); equal reading ids count once (the earliest). Order: time, then reading id. Other columns are ignored. Empty tables: no rows.

    An isolation forest per source scores each reading on its distance to the local level, its two-sided difference, its distance to
    the level usual at that hour, and the length of the run of equal readings it belongs to, all as multiples of what is usual in the source. A
    run counts once when the forest grows, so a long stuck run cannot pass for normal. A reading is a candidate from the source's own ``threshold``
    (see ``_score_source``) up. Candidates are then held against exact rules:

    * ``spike``: at most 3 successive readings that leave the course and return, every one at least SIZE times the source's
      usual change (median of the non-zero changes) away from both neighbours of the excursion;
    * ``stuck``: a run of at least 10 equal readings in a source in which at most the share REPEATS of all runs has more than one reading.

    ``impossible`` (outside the source's limits, where it has any) is a rule of its own that needs no score.

    Result: reading, source, score, threshold, candidate, impossible, spike, stuck, flagged.
    """
    features = checkpointed(reading_features(readings, sources, reading, source, time, value, low, high))
    candidate = F.col("score") >= F.col("threshold")
    spike = candidate & (F.col("size") >= SIZE)
    stuck = candidate & (F.col("run_length") >= STUCK) & (F.col("repeats") <= REPEATS)
    return forest_scores(features).select(
        F.col("_r").alias(reading),
        F.col("_s").alias(source),
        "score",
        "threshold",
        candidate.alias("candidate"),
        "impossible",
        spike.alias("spike"),
        stuck.alias("stuck"),
        (F.col("impossible") | spike | stuck).alias("flagged"),
    )
