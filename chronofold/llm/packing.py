"""Items of varying length into containers of fixed capacity, by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.util import checkpointed, shuffle_partitions


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that finds the tightest class with room in logarithmic time.

    Bins with the same remaining capacity are interchangeable, so a class holds runs of consecutive bin numbers, not single bins.
    """

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, bins: int) -> None:
        if not bins or not room:
            return
        self.runs.setdefault(room, []).append((first, bins))
        i = room + self.width
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            i = room + self.width
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return run

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open bin that is at least ``size``."""
        i = size + self.width
        if self.some[i]:
            return size
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of sizes (1..capacity): the moves, and the number of bins.

    A move (size, rank, bin, each): the items of ``size`` from ``rank`` on fill the bins from ``bin`` on, ``each`` items to a bin, up to the next
    move of that size. Items of one size are interchangeable and so are bins with the same room; a bin that has taken an
    item and still has room for another of its size is then the tightest. So a whole run of bins is filled in one step, with
    the bins that best-fit decreasing gives when it takes items one by one. The steps depend on the sizes that occur, not on the number of items.
    """
    bins, opened, moves = OpenBins(capacity), 0, []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = bins.tightest(size)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            else:
                first, n = bins.take(room)
            each = room // size
            full = min(n, left // each)
            if full:
                moves.append((size, rank, first, each))
                bins.put(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                moves.append((size, rank, first + full, left))
                bins.put(room - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            bins.put(room, first + full, n - full)
    return moves, opened


def pieces(sizes: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """Rows (container, key, piece, first_token, n_tokens): whole items, or pieces of the capacity and a rest where an item exceeds it."""
    kinds = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("capacity")) for c, n in capacities.items()])
    n, cap = F.coalesce(F.col(size), F.lit(0)), F.col("c.capacity")
    each = sizes.select(key, n.cast("long").alias("_n"), F.explode(kinds).alias("c"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / cap) - 1)
    cut = each.select(F.col("c.container").alias("container"), key, "_n", cap.alias("_cap"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * F.col("_cap")
    return cut.select("container", key, "piece", first.alias("first_token"), F.least(F.col("_cap"), F.col("_n") - first).alias("n_tokens"))


def pack(sizes: DataFrame, capacities: dict[str, int], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Assign every item to a bin of each container, by best-fit decreasing over all items.

    Result: container, key, piece, first_token, n_tokens, bin_id (from 0 in each container). An item larger than the capacity is cut into
    pieces of the capacity and a rest; no other item is cut. Items of size 0, NULL or less need no container: one piece, n_tokens 0, bin_id NULL. Every
    row is an item of its own, repeated rows too. Capacities must be positive. Empty table: no rows.

    Best-fit decreasing sees sizes only, and sizes are whole numbers up to the capacity: so it runs on the driver over the histogram of sizes,
    which has at most as many entries as the sum of the capacities. An item finds its bin from its rank among the items of its size. Ranks are
    given in as many hash buckets as there are shuffle partitions, so that a size which a third of all items have is no single task's work.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    names = sorted(capacities)
    buckets = 4 * shuffle_partitions(sizes.sparkSession)
    cut = pieces(sizes.select(key, F.greatest(F.col(size), F.lit(0)).alias("_size")), key, "_size", capacities)
    cut = checkpointed(cut.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int")))
    items = cut.where("n_tokens > 0")
    per_bucket = items.groupBy("container", "n_tokens", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy("container", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_bucket = checkpointed(per_bucket.withColumn("_before", before))
    histogram = per_bucket.groupBy("container", "n_tokens").agg(F.sum("_count").alias("n")).collect()
    starts, firsts, eaches = [], [], []
    base: dict[tuple[str, int], int] = {}
    total = 0
    for c in names:
        counts = {r["n_tokens"]: r["n"] for r in histogram if r["container"] == c}
        moves, _ = best_fit_decreasing(counts, capacities[c])
        for s in sorted(counts, reverse=True):
            base[c, s] = total
            total += counts[s]
        for s, rank, first, each in moves:
            starts.append(base[c, s] + rank)
            firsts.append(first)
            eaches.append(each)
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    plan = tuple(np.array(x, np.int64)[order] for x in (starts, firsts, eaches))
    shared = sizes.sparkSession.sparkContext.broadcast(plan)
    # The base of a size is at most sum(capacities) numbers: a literal map per container would be long, so it joins as rows.
    bases_df = sizes.sparkSession.createDataFrame([(c, s, b) for (c, s), b in base.items()] or [("", 0, 0)], "container string, n_tokens long, _base long")
    offsets = per_bucket.join(F.broadcast(bases_df), ["container", "n_tokens"]).select("container", "n_tokens", "_bucket", (F.col("_base") + F.col("_before")).alias("_offset"))
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("container", "n_tokens", "_bucket").orderBy(key, "piece")) - 1)
    placed = ranked.join(offsets, ["container", "n_tokens", "_bucket"]).select("container", key, "piece", "first_token", "n_tokens", (F.col("_offset") + F.col("_rank")).alias("_at"))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, each = shared.value
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            k = np.searchsorted(start, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[k] + (at - start[k]) // each[k])], [*b.schema.names[:-1], "bin_id"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "_at"), "bin_id long"])
    nothing = cut.where("n_tokens = 0").select("container", key, "piece", "first_token", "n_tokens", F.lit(None).cast("long").alias("bin_id"))
    return placed.mapInArrow(bins, schema).unionByName(nothing)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per container: capacity, bins, items, tokens, and the share of the bins' space that is used."""
    bins = packed.where("bin_id is not null").groupBy("container", "bin_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    cap = F.create_map(*[F.lit(x) for c, n in capacities.items() for x in (c, n)])[F.col("container")]
    return (
        bins.groupBy("container")
        .agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
        .select("container", cap.alias("capacity"), "bins", "items", "tokens", "fullest", (F.col("tokens") / (F.col("bins") * cap)).alias("used_share"))
    )
