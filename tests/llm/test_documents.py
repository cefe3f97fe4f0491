"""Packing, mixing and restoring: brute force, exact round trips and held-out accuracy."""

import bisect
import random
import re

import numpy as np
import pytest

pytest.importorskip("chronofold.llm")

from chronofold.llm import mixing, mojibake, packing, tokens  # noqa: E402

# --- tokens


def test_token_sizes(spark):
    pytest.importorskip("tiktoken")
    import os

    if not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)):
        pytest.skip("no vocabulary")
    long = "word " * 40_000
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, "", "b"), (3, None, None), (4, long, "d"), (4, "<|endoftext|>", "d")], "`doc id` long, text string, _text string")
    got = [tuple(r) for r in tokens.token_sizes(df, ["doc id"]).collect()]
    assert got[0][1] > 1 and [g[1] for g in got[1:3]] == [0, 0] and got[3][1] >= 40_000 and got[4][1] > 1
    assert tokens.token_sizes(df.limit(0), ["doc id"]).count() == 0


# --- packing


def one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - s)
    return rooms


@pytest.mark.parametrize("seed", range(40))
def test_histogram_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 10, 37, 100, 512])
    counts = {}
    for _ in range(rng.randint(0, 300)):
        s = rng.randint(1, capacity)
        counts[s] = counts.get(s, 0) + 1
    moves, bins = packing.best_fit_decreasing(counts, capacity)
    fill = [0] * bins
    for s, n in counts.items():
        mine = sorted((m for m in moves if m[0] == s), key=lambda m: m[1])
        for r in range(n):
            m = mine[bisect.bisect_right([x[1] for x in mine], r) - 1]
            fill[m[2] + (r - m[1]) // m[3]] += s
    assert sorted(capacity - f for f in fill) == one_by_one([s for s, n in counts.items() for _ in range(n)], capacity)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7, rng.randint(0, 250)]), "x") for i in range(400)] + [(3, 11, "x"), (3, 11, "x"), (None, 5, "x"), (900, None, "x"), (901, 200, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, piece string")
    capacities = {"s": 32, "l": 100}
    got = packing.pack(df, capacities).collect()
    for c, cap in capacities.items():
        mine = [r for r in got if r["container"] == c]
        cut = [p for _, n, _ in rows for p in ([0] if not n else [cap] * (n // cap) + ([n % cap] if n % cap else []))]
        assert sorted(r["n_tokens"] for r in mine) == sorted(cut)
        bins = {}
        for r in mine:
            assert (r["bin_id"] is None) == (r["n_tokens"] == 0) and r["first_token"] == r["piece"] * cap
            if r["n_tokens"]:
                bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
        assert sorted(cap - t for t in bins.values()) == one_by_one([p for p in cut if p], cap)
        assert sorted(bins) == list(range(len(bins)))
    report = {r["container"]: r for r in packing.fill_report(packing.pack(df, capacities), capacities).collect()}
    assert report["s"]["fullest"] <= 32 and report["l"]["used_share"] > 0.99
    assert packing.pack(df.limit(0), capacities).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {"none": 0})


# --- mixing


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    a = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(a) == list(range(n))
    if n > 100:
        assert (a != mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 100))).mean() > 0.9


def test_quotas():
    q = mixing.token_quotas({"a": 1000, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 5, "b": 4, "c": 3}, 1000)
    assert q["c"] == 30 and sum(q.values()) == pytest.approx(1000) and q["a"] / q["b"] == pytest.approx(5 / 3)
    assert sum(mixing.token_quotas({"a": 10}, {"a": 1.0}, {"a": 2}, 1000).values()) == 20
    draws = mixing.shard_draws({"a": 700, "b": 300, "c": 0}, 16, 1)
    for s, n in (("a", 700), ("b", 300)):
        mine = [d for d in draws if d[1] == s]
        assert sum(d[3] for d in mine) == n and [d[2] for d in mine] == list(np.cumsum([0] + [d[3] for d in mine])[:-1])


def test_mix_reaches_its_shares_and_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices(["big", "mid", "tiny", None, "other"], [60, 30, 2, 3, 5])[0], rng.choice([0, 3, 50, 900]), "z") for i in range(1500)] + [(1, "mid", 50, "z")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, block string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 3), ("tiny", 0.2, 2), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets, block=32)
    got, told = mixed.collect(), {r["source"]: r for r in report.collect()}
    total = sum(n for _, _, n, _ in rows)
    assert abs(sum(r["n_tokens"] for r in got) - total) < 32 * 8
    tiny = sum(n for _, s, n, _ in rows if s == "tiny")
    assert told["tiny"]["drawn_tokens"] == pytest.approx(2 * tiny, abs=64) and told["big"]["reached_share"] / told["mid"]["reached_share"] == pytest.approx(0.6, rel=0.01)
    assert {s for s in told} == {"big", "mid", "tiny", "absent", "other", None} and told["other"]["drawn_tokens"] == 0
    uses, size = {}, {(d, s): n for d, s, n, _ in rows}
    for r in got:
        assert 0 <= r["first_token"] and r["first_token"] + r["n_tokens"] <= size[r["doc_id"], r["source"]]
    slots = {}
    for r in got:
        slots.setdefault((r["shard"], r["position"]), []).append(r)
        if r["doc_id"] != 1:
            for t in range(r["first_token"], r["first_token"] + r["n_tokens"]):
                uses[r["doc_id"], t] = uses.get((r["doc_id"], t), 0) + 1
    limit = {"big": 1, "mid": 3, "tiny": 2}
    for (d, _), n in uses.items():
        assert n <= max(limit.values())
    assert all(max((n for (d, _), n in uses.items() if (d, s) in size), default=0) <= m for s, m in limit.items())
    assert all(sum(r["n_tokens"] for r in x) <= 32 and len({(r["source"], r["block"]) for r in x}) == 1 for x in slots.values())
    nothing, told = mixing.mix(df.limit(0), targets, block=32)
    assert nothing.count() == 0 and told.count() == 4


# --- restoring

GERMAN = "für über schön Größe Straße während Prüfung grün müde Bäcker öffnen können später täglich Gerät"
RUSSIAN = "погода сегодня очень хорошая вчера был сильный дождь завтра обещают солнце ветер река мост город школа"
FRENCH = "été déjà où très façade élève être même noël pièce après château français création"


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words_ = [GERMAN, RUSSIAN, FRENCH][i % 3].split()
        out.append("\n".join(" ".join(rng.choice(words_) for _ in range(12)) + rng.choice([".", " – 12 °C.", " “ja”.", ""]) for _ in range(4)))
    return out


BREAKS = {
    "utf-8 as cp1252": lambda t: "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in t.encode()),
    "utf-8 as latin-1": lambda t: t.encode().decode("latin-1"),
    "utf-8 twice": lambda t: t.encode().decode("latin-1").encode().decode("latin-1"),
    "utf-8 as cp437": lambda t: t.encode().decode("cp437"),
    "references": lambda t: "".join(c if c < "\x80" else f"&#{ord(c)};" for c in t.encode().decode("latin-1")),
    "cp1252 as mac": lambda t: t.encode("cp1252", "replace").decode("mac_roman"),
    "cp1251 as latin-1": lambda t: t.encode("cp1251", "replace").decode("latin-1"),
    "koi8-r as cp1251": lambda t: t.encode("koi8-r", "replace").decode("cp1251", "replace"),
}


def test_broken_texts_are_found_and_restored(spark):
    clean = corpus()
    rows, truth = [], {}
    for i, t in enumerate(clean):
        kind = None
        if i % 15 == 7:
            names = [b for b in BREAKS if ("cp1252 as" not in b or i % 3 != 1) and ("cp1251" not in b or i % 3 == 1)]
            kind = names[(i // 15) % len(names)]
            if "as mac" in kind or "koi8" in kind or "cp1251" in kind:
                t = t.replace("–", "").replace("“", "").replace("”", "").replace("°", "")
            truth[i] = (kind, t)
            t = BREAKS[kind](t)
        rows.append((i, t, "x"))
    cut = max(rows)[0] + 1
    rows += [(cut, "für schön gr�", "x"), (cut + 1, "f�r schön", "x"), (cut + 2, None, "x"), (cut + 3, "", "x"), (cut + 4, "gr&#252;n", "x"), (None, "für", "x"), (cut + 5, "plain text", "x"), (cut + 6, "für " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r["doc_id"]: r for r in mojibake.restore(df).collect()}
    assert {k for k, r in got.items() if r["garbled"]} == {*truth, cut + 1}
    right = sum(got[i]["restored"] == t for i, (_, t) in truth.items())
    assert right >= 0.9 * len(truth), [(truth[i][0], got[i]["chain"]) for i in truth if got[i]["restored"] != truth[i][1]]
    assert got[cut + 2]["restored"] is None and got[cut + 3]["restored"] == "" and got[cut + 4]["restored"] == "gr&#252;n"
    assert mojibake.restore(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", BREAKS)
def test_a_garbled_page_repeated_often_is_found(spark, kind):
    clean = corpus(150, 5)
    page = re.sub("[–“”°]", "", clean[1 if "cp1251" in kind else 0])
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + k, BREAKS[kind](page)) for k in range(75)]
    got = {r["doc_id"]: r for r in mojibake.restore(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r["garbled"]} == set(range(1000, 1075))
    assert all(got[1000 + k]["restored"] == page for k in range(75))


def test_model_needs_nothing_to_score():
    model = mojibake.Model(np.zeros(2**mojibake.BITS, np.int64), np.zeros(65536, np.int64))
    assert np.isfinite(model.score(["für"])).all() and model.readings(["fÃ¼r"]) == [{}] and model.score([]).size == 0


@pytest.mark.parametrize(
    "right, wrong",
    [
        ("датчик", "датчик".encode("koi8-r").decode("cp866")),
        ("データ", "データ".encode("euc_jp").decode("koi8-r")),
        ("データ", "データ".encode("shift_jis").decode("cp437")),
        ("データ", "データ".encode().decode("shift_jis", "replace")),
        ("тест", "тест".encode("cp1251").decode("shift_jis", "replace")),
        ("датчик", "датчик".encode("cp1251").decode("koi8-r").encode().decode("latin-1")),
        ("データ", "データ".encode("euc_jp").decode("latin-1").encode().decode("cp437")),
        ("größer", "größer".encode().decode("cp1252").encode().decode("mac_roman").encode().decode("latin-1")),
    ],
)
def test_chains_are_tried(right, wrong):
    if "\ufffd" in wrong:
        pytest.skip("characters are lost in this chain")
    got = mojibake.restorations(wrong)
    assert right in got and mojibake.take_chain(wrong, got[right].split()) == right


def test_margin_is_the_validated_one(spark):
    rows = [(f"w{i}", 10, 10, float(i % 5), 0.5) for i in range(100)] + [("odd", 1, 0, 9.26, None)]
    judged = spark.createDataFrame(rows, "word string, n0 long, n1 long, g0 double, g1 double")
    n = sum(r[1] + r[2] for r in rows)
    # Less than one word may gain more: the largest gain, to the next tenth, and what is missing.
    assert mojibake.validated_margin(judged) == pytest.approx(9.3 - np.log(mojibake.FALSE_RATE * n))
    many = judged.withColumns({"n0": judged["n0"] * 1_000_000, "n1": judged["n1"] * 1_000_000})
    # 2,001 of two thousand million words may gain more: the one million of the odd word may not.
    assert mojibake.validated_margin(many) == pytest.approx(9.3)


def test_words_of_garbled_records_do_not_stay_in_training(spark):
    clean = corpus(200, 6)
    rows = [(i, t if i % 12 else BREAKS["utf-8 as cp437"](t)) for i, t in enumerate(clean)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda parts, c: sum(int(n[cell == -1 - ord(c)].sum()) for cell, n in parts)
    before = mojibake.fit_counts(mojibake.counted(documents))
    parts, margin = mojibake.train(documents)
    assert count(parts, "├") <= 0.05 * count(before, "├") and count(parts, "ü") >= 0.9 * count(before, "ü") and 0 < margin < 25
