"""A mix of sources with target shares of its tokens, each source repeated at most so many times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.util import checkpointed, shuffle_partitions

#: Tokens of a block; blocks of one output shard at most; the least number of shards.
BLOCK, SHARD_BLOCKS, SHARDS = 256, 100_000, 64


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, evaluated at ``index``: a Feistel network that walks until it is in range."""
    index, size, key = (np.asarray(x, np.uint64) for x in (index, size, key))
    half = np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for round_ in range(4):
            f = (right + np.uint64(0x9E3779B97F4A7C15 * (round_ + 1) % 2**64)) ^ k
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f ^ (f >> np.uint64(31)))) & m
        out[todo] = (left << h) | right
        todo = out >= size
    return out.astype(np.int64)


def token_quotas(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int) -> dict[str, float]:
    """Tokens each source gives: its share of ``total``, or all it can give; what is then missing goes to the others, by their shares."""
    cap = {s: float(available.get(s, 0)) * max(0, repeats[s]) for s in shares}
    quota = {s: 0.0 for s in shares}
    open_, missing = {s for s in shares if shares[s] > 0 and cap[s] > 0}, float(total)
    while open_ and missing > 0.5:
        weight = sum(shares[s] for s in open_)
        want = {s: quota[s] + missing * shares[s] / weight for s in open_}
        for s in open_:
            quota[s] = min(cap[s], want[s])
        open_ = {s for s in open_ if quota[s] < cap[s]}
        missing = total - sum(quota.values())
    return quota


#: Shards that are drawn for together on the driver.
GROUP = 256
PLAN = pa.schema([("shard", pa.int32()), ("_source", pa.string()), ("_place", pa.int32()), ("_j", pa.int64()), ("_draws", pa.int64()), ("_i", pa.int64()), ("_size", pa.int64()), ("_blocks", pa.int64())])


def slot_quotas(tokens: dict[str, float], available: dict[str, int], repeats: dict[str, int], block: int) -> dict[str, int]:
    """Blocks each source gives: its tokens over the mean length of its blocks (the last is short), to the nearest, within its limit."""
    out = {}
    for s, t in tokens.items():
        n = -(-available.get(s, 0) // block)
        out[s] = min(n * max(0, repeats[s]), round(t * n / available[s])) if n else 0
    return out


def shard_draws(quota: dict[str, int], shards: int, seed: int | list[int], weights: list[int] | None = None) -> list[tuple[int, str, int, int]]:
    """(shard, source, first draw, draws): multinomial counts per shard, conditioned on the quotas being met over all shards.

    ``weights``: the shards that each entry stands for, if these are groups of shards.
    """
    weights = weights or [1] * shards
    standing = sum(weights)
    rng = np.random.default_rng(seed)
    names = sorted(s for s in quota if quota[s])
    left = np.array([quota[s] for s in names], np.int64)
    drawn = np.zeros(len(names), np.int64)
    out = []
    for k in range(shards):
        size = int(left.sum()) * weights[k] // standing
        standing -= weights[k]
        take = left.copy()
        if k < shards - 1:
            # The multinomial conditioned on the totals is the multivariate hypergeometric, drawn one source after another.
            rest, need = int(left.sum()), size
            for i in range(len(names)):
                rest -= int(left[i])
                take[i] = _hypergeometric(rng, int(left[i]), rest, need)
                need -= int(take[i])
        out += [(k, s, int(drawn[i]), int(take[i])) for i, s in enumerate(names) if take[i]]
        drawn, left = drawn + take, left - take
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # Beyond the generator's range the normal limit is exact to less than a block in a shard.
    all_ = good + bad
    mean = n * good / all_
    sd = (mean * (bad / all_) * ((all_ - n) / (all_ - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, sd)), n - bad, 0), good, n))


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", block: int = BLOCK, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Draw a mix with as many tokens as the documents have, and report the shares reached.

    ``targets``: one row per source with ``source``, ``target_share``, ``max_repeats`` (a small table). The documents of a source, in the order of a hash of their
    keys, are one row of tokens, cut into blocks of ``block``. Every source gets the number of blocks that comes nearest to its share; a source
    that cannot give as much gives all its blocks ``max_repeats`` times, and the rest goes to the others by their shares. Counts per output
    shard are multinomial draws, conditioned on those numbers. Draw j of a source is block perm(j mod n) of its pass j div n, with a new permutation of its n
    blocks for every pass: so no token is used more often than ``max_repeats``. Draws and documents meet in an equi-join on (source, block).

    The mix: one row per drawn block and document in it: shard, position (in the shard), source, block, pass, key, first_token, n_tokens
    (the part of the document). The report: source, target_share, max_repeats, available_tokens, drawn_tokens, reached_share, most_uses, for every
    source in either table. Documents without a source, with a source that has no target, or without tokens are not drawn. If all sources
    together cannot give as many tokens, the mix is smaller. Every row is a document of its own. Empty table: an empty mix.
    """
    spark = sizes.sparkSession
    config = {r["source"]: r for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()}
    shares = {s: float(r["target_share"] or 0) for s, r in config.items()}
    repeats = {s: int(r["max_repeats"] or 0) for s, r in config.items()}
    docs = checkpointed(sizes.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_n")))
    of_source = docs.groupBy("_source").agg(F.sum("_n").alias("available_tokens"))
    total = docs.agg(F.sum("_n").alias("t")).collect()[0]["t"] or 0
    wanted = list(shares)
    available = {r["_source"]: r["available_tokens"] for r in of_source.where(F.col("_source").isin(wanted) if wanted else F.lit(False)).collect()}
    blocks = {s: -(-n // block) for s, n in available.items()}
    quota = slot_quotas(token_quotas(available, shares, repeats, total), available, repeats, block)
    slots = sum(quota.values())
    shards = max(SHARDS, -(-slots // SHARD_BLOCKS))

    # Where each document begins in its source's row of tokens: a prefix sum in hash buckets, so that a large source is many tasks' work.
    buckets = 4 * shuffle_partitions(spark)
    live = docs.where((F.col("_n") > 0) & (F.col("_source").isin(wanted) if wanted else F.lit(False))).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    sums = live.groupBy("_source", "_bucket").agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = Window.partitionBy("_source", "_bucket").orderBy("_key", "_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = live.withColumn("_at", F.coalesce(F.sum("_n").over(here), F.lit(0))).join(sums.drop("_sum"), ["_source", "_bucket"]).withColumn("_at", F.col("_at") + F.col("_base"))
    b = F.lit(block).cast("long")
    parts = placed.select("_source", "_key", "_n", "_at", F.explode(F.sequence(F.floor(F.col("_at") / b), F.floor((F.col("_at") + F.col("_n") - 1) / b))).alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * b - F.col("_at"))
    parts = parts.select("_source", "block", "_key", first.alias("first_token"), (F.least(F.col("_n"), (F.col("block") + 1) * b - F.col("_at")) - first).alias("n_tokens"))

    place = {s: i for i, s in enumerate(sorted(shares))}
    # The driver draws for groups of shards only; each group draws for its shards where it lies.
    weights = [min(GROUP, shards - k) for k in range(0, shards, GROUP)]
    of_group: dict[int, list[tuple[str, int, int]]] = {}
    for g, s, j, n in shard_draws(quota, len(weights), seed, weights):
        of_group.setdefault(g, []).append((s, j, n))
    rows = [(g, weights[g], [s for s, _, _ in x], [place[s] for s, _, _ in x], [blocks[s] for s, _, _ in x], [j for _, j, _ in x], [n for _, _, n in x]) for g, x in of_group.items()]
    groups = spark.createDataFrame(rows, "g int, shards int, sources array<string>, places array<int>, blocks array<long>, firsts array<long>, draws array<long>")

    def shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                of = {s: (p, b, j) for s, p, b, j in zip(r["sources"], r["places"], r["blocks"], r["firsts"])}
                draws = shard_draws(dict(zip(r["sources"], r["draws"])), r["shards"], [seed, r["g"]])
                sizes_of: dict[int, int] = {}
                for k, _, _, n in draws:
                    sizes_of[k] = sizes_of.get(k, 0) + n
                before: dict[int, int] = {}
                out = []
                for k, s, j, n in draws:
                    p, b, first = of[s]
                    out.append({"shard": r["g"] * GROUP + k, "_source": s, "_place": p, "_j": first + j, "_draws": n, "_i": before.get(k, 0), "_size": sizes_of[k], "_blocks": b})
                    before[k] = before.get(k, 0) + n
                if out:
                    yield pa.RecordBatch.from_pylist(out, PLAN)

    plan = groups.repartition(max(1, min(len(rows), shuffle_partitions(spark))), "g").mapInArrow(shared_out, "shard int, _source string, _place int, _j long, _draws long, _i long, _size long, _blocks long")
    plan = plan.repartition(max(1, min(shards, shuffle_partitions(spark))), "shard")
    draw = plan.select("shard", "_source", "_place", "_j", "_i", "_size", "_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1)).alias("_k"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            c = {n: x.column(i) for i, n in enumerate(x.schema.names)}
            v = {n: c[n].to_numpy().astype(np.uint64) for n in c if n != "_source"}
            j = v["_j"] + v["_k"]
            turn = j // v["_blocks"]
            s = np.uint64(seed * 0xD1342543DE82EF95 % 2**64)
            index = permuted(j % v["_blocks"], v["_blocks"], s + v["_place"] * np.uint64(1_000_003) + turn * np.uint64(7_919))
            position = permuted(v["_i"] + v["_k"], v["_size"], s + np.uint64(1 << 40) + v["shard"])
            yield pa.RecordBatch.from_arrays([c["shard"], pa.array(position), c["_source"], pa.array(index), pa.array(turn.astype(np.int32))], ["shard", "position", "_source", "block", "pass"])

    drawn = draw.mapInArrow(mapped, "shard int, position long, _source string, block long, pass int")
    # Both sides grow with the corpus, though the planner takes the draws, which come from a short list, for small.
    mixed = drawn.hint("merge").join(parts.hint("merge"), ["_source", "block"]).select("shard", "position", F.col("_source").alias("source"), "block", "pass", F.col("_key").alias(key), "first_token", "n_tokens")

    uses = mixed.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.countDistinct("pass").alias("u"))
    reached = uses.groupBy("source").agg(F.sum("t").alias("drawn_tokens"), F.max("u").alias("most_uses"))
    config_df = spark.createDataFrame([(s, shares[s], repeats[s]) for s in shares], "source string, target_share double, max_repeats int")
    every = of_source.withColumnRenamed("_source", "source").join(F.broadcast(config_df), "source", "full").join(reached, "source", "left")
    all_drawn = reached.agg(F.sum("drawn_tokens").alias("d")).scalar()
    report = every.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.coalesce(F.try_divide(F.col("drawn_tokens").cast("double"), all_drawn), F.lit(0.0)).alias("reached_share"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return mixed, report
