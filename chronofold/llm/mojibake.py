"""Text decoded with the wrong character encoding: find it and restore it.

A smoothed character bigram model is trained on the clean records of the corpus. Every word with characters beyond ASCII is scored
under the model, as it stands and as every chain of "encode as E, decode as D" steps makes it; a line's likeliest chain is
accepted if the line gains more by it than a margin validated on held-out clean records.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.util import checkpointed, spread_out

#: The 8-bit code pages a text is wrongly or rightly read in.
PAGES = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman")
#: Multi-byte encodings whose text was read in an 8-bit page.
WIDE = ("shift_jis", "euc_jp")
CUT = "�"
DEPTH = 3

#: The model's table of bigrams has 2 ** BITS cells, whatever the corpus; a collision adds two counts.
BITS = 22
#: A character is known from this share in the clean words up.
KNOWN_SHARE = 2e-7
#: Words longer than this are scored but not remembered.
REMEMBER_LENGTH, REMEMBER = 48, 300_000


def _page_maps() -> dict[str, tuple[dict[str, int], list[str]]]:
    """Per page: character -> byte, and byte -> character. Bytes that a page leaves undefined are control characters, as browsers read them."""
    out = {}
    for page in PAGES:
        chars = []
        for b in range(128, 256):
            try:
                chars.append(bytes([b]).decode(page))
            except UnicodeDecodeError:
                chars.append(chr(b))
        out[page] = ({c: b + 128 for b, c in enumerate(chars)}, chars)
    return out


_MAPS = _page_maps()
_PAIRS = {(e, d): str.maketrans({c: _MAPS[d][1][b - 128] for c, b in _MAPS[e][0].items() if _MAPS[d][1][b - 128] != c}) for e in PAGES for d in PAGES if e != d}
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
#: Per page: its characters as the bytes they stand for; a character of Latin-1 that is none of the page's moves out of the way.
_AS_BYTES = {e: str.maketrans({**{chr(b): chr(0xF0000 + b) for b in range(128, 256)}, **{c: chr(b) for c, b in m[0].items()}}) for e, m in _MAPS.items()}
#: Per page: a character that begins a sequence of UTF-8 before one that goes on.
_BEGUN = {e: re.compile(f"[{re.escape(''.join(m[1][0xC2 - 128 : 0xF5 - 128]))}][{re.escape(''.join(m[1][: 0xC0 - 128]))}]") for e, m in _MAPS.items()}
_REFERENCE = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?")


def read_references(word: str) -> str:
    """Numeric character references as the characters they name."""

    def one(m: re.Match) -> str:
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _REFERENCE.sub(one, word) if "&#" in word else word


def _utf8_within(word: str, page: str) -> str:
    """The word with every part that is UTF-8 read in ``page`` decoded; other parts stay."""
    moved = word.translate(_AS_BYTES[page])
    done = []
    last = 0
    for m in _UTF8.finditer(moved):
        done.append((last, m.start(), None))
        done.append((0, 0, m[0].encode("latin-1").decode("utf-8", "replace")))
        last = m.end()
    if not last:
        return word
    done.append((last, len(moved), None))
    return "".join(word[a:b] if s is None else s for a, b, s in done)


@lru_cache(maxsize=200_000)
def _page_readings(beyond: str, known: frozenset[str] | None) -> tuple[tuple[str, str], ...]:
    """The distinct page-for-page readings of a set of characters, with their chains: those in known characters, if these are given."""
    found: dict[str, str] = {}
    for e in PAGES:
        page = _MAPS[e][0]
        if all(c in page for c in beyond):
            for d in PAGES:
                if e != d:
                    r = beyond.translate(_PAIRS[e, d])
                    if known is None or known.issuperset(r):
                        found.setdefault(r, f"{e}>{d} ")
    found.pop(beyond, None)
    return tuple(found.items())


def _raw(word: str, page: str) -> bytes | None:
    """The bytes of a word in an encoding; None if it cannot be written in it."""
    if page in _MAPS:
        places = _MAPS[page][0]
        try:
            return bytes(places[c] if c > "\x7f" else ord(c) for c in word)
        except KeyError:
            return None
    try:
        return word.encode(page)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=100_000)
def take_step(word: str, step: str) -> str | None:
    """One step "encode as E, decode as D" on a word; None if the word cannot be taken so. A step that ends in utf-8 changes the parts that are UTF-8."""
    e, d = step.split(">")
    if d == "utf-8" and e in _MAPS:
        return _utf8_within(word, e)
    if e in _MAPS and d in _MAPS:
        return word.translate(_PAIRS[e, d])
    if e == "utf-16-be":
        return word.encode(e, "surrogatepass").decode(d, "replace")
    raw = _raw(word, e)
    if raw is None:
        return None
    if d in _MAPS:
        return "".join(chr(b) if b < 128 else _MAPS[d][1][b - 128] for b in raw)
    read = raw.decode(d, "replace")
    return read if read.count(CUT) <= len(read) // 10 else None


#: Steps between 8-bit pages and multi-byte encodings, both ways, and between multi-byte encodings.
_WIDE_STEPS = {e: [f"{e}>{d}" for d in WIDE] for e in PAGES} | {e: [f"{e}>{d}" for d in ("utf-8", *WIDE, *PAGES) if d != e] for e in WIDE}
_JAPANESE = re.compile("[\u3000-\u30ff\uff61-\uff9f\u4e00-\u9fff]")


def restorations(word: str, known: frozenset[str] | None = None) -> dict[str, str]:
    """Every other reading of a word -> the chain of steps that gives it; with ``known``, only readings in those characters.

    Chains: UTF-8 read in any page, up to DEPTH times over; one page read as another; multi-byte encodings read in a page and the
    other way round; byte order; and each of the single steps after steps of UTF-8.
    """
    found: dict[str, str] = {}
    level = {word: ""}
    for depth in range(DEPTH + 1):
        new: dict[str, str] = {}
        for w, chain in level.items():
            beyond = "".join(sorted({c for c in w if c > "\x7f"}))
            if len(beyond) > 1 and depth < DEPTH:
                for e in PAGES:
                    if _BEGUN[e].search(w):
                        r = _utf8_within(w, e)
                        if r != w and r not in found and r not in new:
                            new[r] = f"{chain}{e}>utf-8 "
            # A page read as another changes all of a word; so every character must be one that the wrong page has.
            for r, step in _page_readings(beyond, known):
                found.setdefault(w.translate(dict(zip(map(ord, beyond), r))), chain + step)
            if len(beyond) > 1:
                for e in (*PAGES, *(WIDE if _JAPANESE.search(w) else ())):
                    if e in WIDE or all(c in _MAPS[e][0] for c in beyond):
                        for step in _WIDE_STEPS[e]:
                            if (r := take_step(w, step)) is not None:
                                found.setdefault(r, f"{chain}{step} ")
            if any(c > "\u01ff" for c in beyond) and CUT not in beyond:
                found.setdefault(take_step(w, "utf-16-be>utf-16-le"), f"{chain}utf-16-be>utf-16-le ")
        found |= new
        level = new
        if not level:
            break
    found.pop(word, None)
    if known is not None:
        return {r: c for r, c in found.items() if known.issuperset(r)}
    return found


def words(text: str) -> list[str]:
    """The words with characters beyond ASCII or with numeric references; only ASCII white space separates words."""
    parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    if "&#" in text:
        return [w for w in parts if not w.isascii() or "&#" in w]
    return [w for w in parts if not w.isascii()]


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings, each between two zeros, and where each string's bigrams begin."""
    joined = "\0" + "\0".join(strings) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), 0, codes)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _cells(codes: np.ndarray) -> np.ndarray:
    """Table cell of each bigram."""
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


#: In training, a record with a control character or a replaced one is not clean.
_CONTROL = re.compile("[\x80-\x9f\ufffd]")


def _form(word: str) -> str:
    """Words in capitals (three letters or more) are judged in small letters: capitals are too rare for counts of their own."""
    return word.lower() if len(word) > 2 and word.isupper() and sum(map(str.isalpha, word)) > 2 else word


def add_bigrams(found: dict[str, int], counts: np.ndarray, singles: np.ndarray) -> None:
    """Add the bigrams of words seen so many times; ``singles`` counts each bigram's second character."""
    if not found:
        return
    codes, starts = _codes([_form(w) for w in found])
    times = np.repeat(np.fromiter(found.values(), np.int64, len(found)), np.diff(np.append(starts, len(codes) - 1)))
    np.add.at(counts, _cells(codes), times)
    np.add.at(singles, np.minimum(codes[1:], 0xFFFF), times)


class Model:
    """Bigram model: log P(b | a), with a Dirichlet prior of weight LEAN on the share of b among all characters."""

    LEAN = 2.0

    def __init__(self, counts: np.ndarray, singles: np.ndarray) -> None:
        self.counts = counts.astype(np.float32)
        self.single = ((singles + 0.05) / (singles.sum() + 0.05 * len(singles))).astype(np.float32)
        #: Every character begins as many bigrams as it ends.
        self.begins = singles.astype(np.float32)
        #: Characters with a share in the clean words: only these may appear in a restored word.
        least = max(2, int(singles.sum() * KNOWN_SHARE))
        known = {chr(c) for c in np.nonzero(singles >= least)[0]}
        self.known = frozenset(known | {u for c in known if len(u := c.upper()) == 1} | set(map(chr, range(32, 127))) | set("\t\n\r"))

    def logs(self, codes: np.ndarray) -> np.ndarray:
        a, b = np.minimum(codes[:-1], 0xFFFF), np.minimum(codes[1:], 0xFFFF)
        return np.log((self.counts[_cells(codes)] + self.LEAN * self.single[b]) / (self.begins[a] + self.LEAN))

    def score(self, strings: list[str]) -> np.ndarray:
        """The log probability of each string: the sum over its bigrams."""
        if not strings:
            return np.zeros(0)
        codes, starts = _codes([_form(w) for w in strings])
        return np.add.reduceat(self.logs(codes).astype(np.float64), starts)

    def prior(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        codes, starts = _codes([_form(w) for w in strings])
        shares = np.log(self.single[np.minimum(codes[1:], 0xFFFF)])
        return np.add.reduceat(np.where(codes[1:] == 0, 0.0, shares), starts)

    def gains(self, found: list[str], others: list[dict[str, str]], prior: float = 0.0) -> list[dict[str, tuple[float, str]]]:
        """For each word and its readings with their chains: reading -> (gain in nats over the word as it stands, chain).

        ``prior`` adds the weighted share of the characters themselves: a text that is garbled one to one has the same conditional probabilities
        as the original once it is in the counts.
        """
        plain = [read_references(w) for w in found]
        texts = plain + [r for readings in others for r in readings]
        total = self.score(texts)
        if prior:
            total = total + prior * self.prior(texts)
        out, at = [], len(plain)
        for i, readings in enumerate(others):
            out.append({r: (float(total[at + k] - total[i]), chain) for k, (r, chain) in enumerate(readings.items())})
            at += len(readings)
        return out

    def readings(self, found: list[str]) -> list[dict[str, str]]:
        """The readings of each word in known characters; isolated letters say nothing about the page they were read in, but for UTF-8."""
        out = []
        for w in found:
            plain = read_references(w)
            others = restorations(plain, self.known)
            if others and sum(c.isalnum() for c in plain) <= 1 and any(c > "\x7f" and c.isalpha() for c in plain):
                others = {r: chain for r, chain in others.items() if "utf-8" in chain}
            out.append(others)
        return out


#: Training: a word is left out if a reading of it is likelier by ATTESTED and more frequent in the corpus, or likelier by SURE.
ATTESTED, SURE, PRIOR = 2.0, 12.0, 0.25
#: Records are dealt to so many folds; the words of a fold are judged by the model of the others. Rounds of cleaning at most.
FOLDS, ROUNDS = 2, 8
#: The share of word occurrences in clean held-out records that may gain the margin.
FALSE_RATE = 1e-6
#: A word that a chain would turn into characters never seen tells so much against the chain, in nats.
AGAINST = 12.0
ANY_UTF8 = "utf-8"


def _words_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean records as a hash of the text with its words, in bounded batches."""
    seen: dict[int, str] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.string())], ["page", "words"])
        seen.clear()
        return out

    for b in batches:
        for text in b.column(0).to_pylist():
            if text and not (text.isascii() and "&#" not in text) and not _CONTROL.search(text):
                key = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                if key not in seen:
                    seen[key] = " ".join(words(text))
                    size += len(seen[key])
                if size > 2_000_000:
                    yield flush()
                    size = 0
    if seen:
        yield flush()


def counted(documents: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words of the clean records with how often they occur in the distinct texts of each fold: a page that is repeated counts once.

    Lines that many texts share (menus, notices) count in each: they tell how these words are usually written. Columns: word, n0, n1.
    """
    pages = documents.select(F.col(text).cast("string")).mapInArrow(_words_of_texts, "page long, words string").distinct()
    fold = F.pmod("page", F.lit(FOLDS))
    each = pages.select(fold.alias("fold"), F.explode(F.split("words", " ")).alias("word"))
    return each.groupBy("word").agg(*[F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)])


def _bigram_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [(np.zeros(2**BITS, np.int64), np.zeros(65536, np.int64)) for _ in range(FOLDS)]
    for b in batches:
        plain = [read_references(w) for w in b.column(0).to_pylist()]
        for f, (counts, singles) in enumerate(sums):
            found: Counter[str] = Counter()
            for w, n in zip(plain, b.column(1 + f).to_pylist()):
                if n:
                    found[w] += n
            add_bigrams(found, counts, singles)
    for f, (counts, singles) in enumerate(sums):
        full, letters = np.nonzero(counts)[0], np.nonzero(singles)[0]
        cells = np.concatenate([full, -1 - letters])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), f)), pa.array(cells), pa.array(np.concatenate([counts[full], singles[letters]]))], ["fold", "cell", "n"])


def fit_counts(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per fold, the bigram and character counts of all words as (cells, sums): at most 2 ** BITS + 65536 of them, whatever the corpus."""
    rows = found.select("word", *[f"n{f}" for f in range(FOLDS)]).mapInArrow(_bigram_cells, "fold long, cell long, n long").groupBy("fold", "cell").agg(F.sum("n").alias("n")).toArrow()
    fold, cell, n = (rows.column(c).to_numpy() for c in ("fold", "cell", "n"))
    return [(cell[fold == f], n[fold == f]) for f in range(FOLDS)]


def model_of(*parts: tuple[np.ndarray, np.ndarray]) -> Model:
    """The model of some folds' counts."""
    counts, singles = np.zeros(2**BITS, np.int64), np.zeros(65536, np.int64)
    for cell, n in parts:
        counts[cell[cell >= 0]] += n[cell >= 0]
        singles[-1 - cell[cell < 0]] += n[cell < 0]
    return Model(counts, singles)


#: Models and readers of a worker process, by the number of their broadcast: they outlive a task.
_at_hand: dict[tuple[str, int], object] = {}


def _kept(kind: str, number: int, make) -> object:
    if (kind, number) not in _at_hand:
        for old in [k for k in _at_hand if k[0] == kind]:
            del _at_hand[old]
        _at_hand[kind, number] = make()
    return _at_hand[kind, number]


def _with_readings(found: DataFrame, parts: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The words with their readings in known characters."""
    shared = found.sparkSession.sparkContext.broadcast(parts)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _kept("readings", number, lambda: model_of(*shared.value))
        for b in batches:
            others = model.readings(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(r) for r in others], pa.list_(pa.string()))], [*b.schema.names, "readings"])

    return spread_out(found).mapInArrow(run, "word string, " + "".join(f"n{f} long, " for f in range(FOLDS)) + "readings array<string>")


def _judged(words_: DataFrame, parts: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Every word under the model of the folds it is not judged in.

    Adds ``g0``, ``g1`` (the most it gains in either fold; NULL where the fold does not have it), ``sure`` (some reading gains more than SURE) and
    ``likelier`` (the readings that gain more than ATTESTED).
    """
    shared = words_.sparkSession.sparkContext.broadcast(parts)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _kept("judged", number, lambda: [model_of(*(p for g, p in enumerate(shared.value) if g != f)) for f in range(FOLDS)])
        for b in batches:
            found = b.column("word").to_pylist()
            others = [dict.fromkeys(r, "") for r in b.column("readings").to_pylist()]
            best: list[list[float | None]] = []
            sure, likelier = np.zeros(len(found), bool), [set() for _ in found]
            for f, model in enumerate(models):
                here = np.flatnonzero(b.column(f"n{f}").to_numpy())
                g: list[float | None] = [None] * len(found)
                some, theirs = [found[i] for i in here], [others[i] for i in here]
                for i, plain in zip(here, model.gains(some, theirs)):
                    g[i] = max((x for x, _ in plain.values()), default=0.0)
                for i, leaning in zip(here, model.gains(some, theirs, PRIOR)):
                    sure[i] |= any(x > SURE for x, _ in leaning.values())
                    likelier[i].update(r for r, (x, _) in leaning.items() if x > ATTESTED)
                best.append(g)
            more = [*(pa.array(g, pa.float64()) for g in best), pa.array(sure), pa.array([sorted(x) for x in likelier], pa.list_(pa.string()))]
            names = [*(f"g{f}" for f in range(FOLDS)), "sure", "likelier"]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    fixed = "word string, " + "".join(f"n{f} long, " for f in range(FOLDS)) + "readings array<string>, "
    return spread_out(words_).mapInArrow(run, fixed + "".join(f"g{f} double, " for f in range(FOLDS)) + "sure boolean, likelier array<string>")


def validated_margin(judged: DataFrame) -> float:
    """The least gain that at most the share FALSE_RATE of the words of clean held-out records exceeds, over all of them.

    If that is less than one word, it is the largest gain plus what is missing: a likelihood ratio exceeds e ** g on no more than a share e ** -g.
    """
    each = judged.select(F.explode(F.array(*[F.struct(F.col(f"n{f}").alias("n"), F.col(f"g{f}").alias("g")) for f in range(FOLDS)])).alias("x")).select("x.*").where("g is not null")
    # Tenths of a nat: a few hundred sums.
    bins = each.groupBy(F.ceil(F.greatest(F.col("g"), F.lit(0.0)) * 10).alias("tenth")).agg(F.sum("n").alias("n")).collect()
    allowed = FALSE_RATE * sum(r["n"] for r in bins)
    if not bins:
        return SURE
    if allowed < 1:
        return max(r["tenth"] for r in bins) / 10 + float(-np.log(allowed))
    above = 0
    for r in sorted(bins, key=lambda r: -r["tenth"]):
        above += r["n"]
        if above > allowed:
            return max(r["tenth"], 1) / 10
    return 0.1


class Reader:
    """Scores and restores texts; remembers the readings of words."""

    def __init__(self, model: Model, margin: float) -> None:
        self.model, self.margin = model, margin
        #: Per word: the most it can gain, and its readings (reading -> gain, chain) if that is more than 0.
        self.seen: dict[str, tuple[float, dict[str, tuple[float, str]]]] = {}

    def learn(self, found: set[str]) -> None:
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        new = [w for w in found if w not in self.seen]
        for w, gains in zip(new, self.model.gains(new, self.model.readings(new))):
            best = max((g for g, _ in gains.values()), default=0.0)
            self.seen[w] = (best, gains) if best > 0 else (0.0, {})

    def line(self, found: list[str]) -> tuple[float, str]:
        """The best chain of a line's distinct words and its log likelihood ratio over the line as it stands.

        UTF-8 may have been read in one page here and in another there, with the same bytes, and in parts of a text only: its chains count as
        one, and words it does not improve stay. Any other chain changes every word it can, and what that costs counts too.
        """
        most = sum(self.seen[w][0] for w in found)
        utf8 = sum(max((g for g, chain in self.seen[w][1].values() if chain.endswith(">utf-8 ")), default=0.0) for w in found if self.seen[w][0] > 0)
        best = (max(utf8, 0.0), ANY_UTF8 if utf8 > 0 else "")
        if utf8 >= most - 1e-9:
            return best
        votes: dict[str, float] = {}
        for w in found:
            for g, chain in self.seen[w][1].values():
                if g > 0 and not chain.endswith(">utf-8 "):
                    votes[chain] = votes.get(chain, 0.0) + g
        order = sorted(found, key=lambda w: -self.seen[w][0])
        for chain in sorted(votes, key=lambda c: (-votes[c], c)):
            gain = self.chain_gain(order, chain.split(), most, best[0])
            if gain > best[0]:
                best = (gain, chain)
        return best

    def chain_gain(self, order: list[str], steps: list[str], most: float, beat: float) -> float:
        """What a chain gains over all words of a line; less than that if it cannot come up to ``beat``, even if all words left gain the most they can."""
        gain, ask = 0.0, []
        for w in order:
            if gain + most <= beat:
                return gain
            plain = read_references(w)
            r = take_chain(plain, steps)
            most -= self.seen[w][0]
            if r is None or (r != plain and not self.model.known.issuperset(r)):
                gain -= AGAINST
            elif r != plain:
                if known := self.seen[w][1].get(r):
                    gain += known[0]
                else:
                    ask += (plain, r)
        if ask and gain > beat:
            scores = self.model.score(ask)
            gain += float(scores[1::2].sum() - scores[::2].sum())
        return gain

    def restored(self, word: str, chain: str, steps: list[str]) -> str:
        """A word of a line that the chain restores; of a line that was UTF-8, by the line's own steps where they lead, else by what is best for the word."""
        plain = read_references(word)
        r = take_chain(plain, steps)
        good = r is not None and r != plain and self.model.known.issuperset(r)
        if chain != ANY_UTF8:
            return r if good else word
        gains = self.seen[word][1]
        if good and gains.get(r, (0.0,))[0] > 0:
            return r
        return max(((g, r) for r, (g, c) in gains.items() if g > 0 and c.endswith(">utf-8 ")), default=(0.0, word))[1]

    def steps(self, found: list[str], chain: str) -> list[str]:
        """The steps of a line's chain; for UTF-8, those that gain most over its words: one page read all of a line."""
        if chain != ANY_UTF8:
            return chain.split()
        live = [w for w in found if self.seen[w][0] > 0]
        totals: dict[str, float] = {}
        for c in {c for w in live for g, c in self.seen[w][1].values() if g > 0 and c.endswith(">utf-8 ")}:
            readings = [(w, take_chain(read_references(w), c.split())) for w in live]
            totals[c] = sum(max(self.seen[w][1].get(r, (0.0,))[0], 0.0) for w, r in readings)
        return max(totals, key=lambda c: (totals[c], -len(c), c)).split()

    def read(self, text: str | None) -> tuple[bool, bool, float, str, str | None]:
        """(found, found by rule, gain, chain, restored) of one text whose words have been learned.

        A mark of a replaced character counts as found too, unless it ends the text: that is where a body was cut off.
        """
        if not text or (text.isascii() and "&#" not in text):
            return False, False, 0.0, "", text
        lost = CUT in text.rstrip(CUT + " \n\r\t")
        best, lines, changed = (0.0, ""), [], False
        for line in text.split("\n"):
            found = list(dict.fromkeys(words(line)))
            # No chain can gain more than all words together at their best.
            if sum(self.seen[w][0] for w in found) >= self.margin:
                gain, chain = self.line(found)
                steps = self.steps(found, chain) if chain and (gain > best[0] or gain >= self.margin) else []
                if gain > best[0]:
                    best = (gain, " ".join(steps))
                if gain >= self.margin:
                    changed, mine = True, set(found)
                    line = re.sub(r"[^ \t\r]+", lambda m: self.restored(m[0], chain, steps) if m[0] in mine else m[0], line)
            lines.append(line)
        return lost or best[0] >= self.margin, lost, best[0], best[1], "\n".join(lines) if changed else text


def take_chain(word: str, steps: list[str]) -> str | None:
    """All steps of a chain on a word; None if one cannot be taken."""
    for step in steps:
        if (word := take_step(word, step)) is None:
            return None
    return word


def train(documents: DataFrame, text: str = "text") -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """The counts behind the character model of the corpus and the margin, over all records.

    1. Distinct words of the clean records with their counts over distinct texts, in two folds of records. 2. All readings of every word. 3. Every
    word is judged by the model of the fold its records are not in; words with a likelier reading that is more frequent in the
    corpus, or with a far likelier one, are left out, and the models are fitted again, until no word is left out. 4. The margin is validated on all
    remaining words, each under the model without its own records. 5. The final counts are those of all remaining words.
    """
    found = checkpointed(counted(documents, text))
    kept = checkpointed(_with_readings(found, fit_counts(found)))
    total = sum((F.col(f"n{f}") for f in range(1, FOLDS)), F.col("n0"))
    for _ in range(ROUNDS):
        parts = fit_counts(kept)
        judged = checkpointed(_judged(kept, parts))
        other = judged.select("word", total.alias("n"), F.explode("likelier").alias("reading"))
        attested = other.join(judged.select(F.col("word").alias("reading"), total.alias("m")), "reading").where("m > n").select("word")
        bad = checkpointed(judged.where("sure").select("word").unionByName(attested).distinct())
        if bad.isEmpty():
            break
        kept = checkpointed(judged.select(*kept.columns).join(bad, "word", "left_anti"))
    else:
        parts = fit_counts(kept)
        judged = _judged(kept, parts)
    return parts, validated_margin(judged)


def restore(documents: DataFrame, key: str = "doc_id", text: str = "text", model: tuple[list[tuple[np.ndarray, np.ndarray]], float] | None = None) -> DataFrame:
    """Garbled documents, with the text restored where possible.

    One row per input row: key, garbled, by_rule (characters were lost for good inside the text; needs no model), gain (log likelihood ratio of
    the best line), chain (its steps, in order), restored (the
    text with every line restored whose gain reaches the margin; the text itself otherwise). NULL and empty texts are not garbled. Numeric
    character references are read before they are judged. Texts with characters lost for good are garbled, with what remains restored.
    Other columns are ignored; ``key`` must be BIGINT (NULL and repeated keys are fine). Empty table: no rows.
    """
    fitted = model or train(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(fitted)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _kept("reader", number, lambda: Reader(model_of(*shared.value[0]), shared.value[1]))
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                texts = b.column(1).to_pylist()
                reader.learn({w for t in texts if t and not (t.isascii() and "&#" not in t) for w in words(t)})
                rows = [reader.read(t) for t in texts]
                for w in [w for w in reader.seen if len(w) > REMEMBER_LENGTH]:
                    del reader.seen[w]
                cols = list(zip(*rows))
                names = ["key", "garbled", "by_rule", "gain", "chain", "restored"]
                types = [pa.bool_(), pa.bool_(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    rows = spread_out(documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")))
    out = rows.mapInArrow(run, "key long, garbled boolean, by_rule boolean, gain double, chain string, restored string")
    return out.withColumnRenamed("key", key)
