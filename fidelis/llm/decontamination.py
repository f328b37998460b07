"""Benchmark decontamination by template canonicalisation.

Words are lowered and stripped of punctuation at their ends; numbers, units behind numbers and names (capitalised words
that begin no sentence) become typed placeholders, and what they stood for is kept aside as slots. Windows of ``WINDOW``
canonical words are compared by hash. Where windows of a document and of a benchmark item agree along one diagonal, the
slots are checked: one value of the item must always stand for one value of the document, and the other way round, in
each run of overlapping windows; where a window breaks this, a new run begins with it. So a question whose numbers or
names were replaced consistently is caught as far as they were, and a chance agreement of placeholders is not.

Words of the documents are canonicalised as arrays, by their 64-bit hashes; only those that the cache of a worker has not
met are looked at as text, and only documents with a window of the benchmark are split into words. The benchmark is read
in blocks of ``BLOCK`` words (one more item at most), each sent to all executors as arrays of 24 bytes a window and
compared with all documents in one narrow pass; a benchmark of any size only makes more passes.

Windows are compared as they stand too, word for word, so an exact copy is found whatever its words are. The first word
of an item, if it is capitalised, is read both as a word and as a name, as a document may have anything before it.

Special input: a null or empty text, on either side, has no windows; an item with fewer words than a window is one
window of its own length, however short; with fewer than ``LITERALS`` literal words a window proves nothing about other
numbers or names and is compared word for word alone; null item ids are left out; a null ``doc_id`` is carried through; repeated rows are judged each by
itself; equal items are all named; empty tables give empty results; other columns are passed on by ``clean``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.store import fresh
from fidelis.llm.text import Words, gram_hashes, hashes_of, mix, pieces, split_words

WINDOW, LITERALS = 8, 5
BLOCK = 1_000_000
#: Words that a worker remembers when it reads texts word for word, and places of its cache of word hashes.
MEMO, CACHE = 300_000, 1 << 18

# Units that are placeholders behind a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw v a j kj cal kcal "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees"
).split()
_UNITS = frozenset(UNITS)
_NUMBER = re.compile(r"[+-]?[$€£]?(\d[\d.,]*)(%|[A-Za-z]{1,3})?")
_EDGES = re.compile(r"^\W+|\W+$")
LITERAL, CAPITAL, NUMBER, UNIT, EMPTY = range(5)
#: Hashes of the placeholders of a number, a unit and a name.
_NUM, _UNIT, _NAME = (np.uint64(x) for x in mix(np.array([11, 12, 13], np.uint64)))


def reading(word: str) -> tuple[int, bool, str]:
    """Kind of a word, whether it ends a sentence, and what is hashed of it."""
    core = _EDGES.sub("", word)
    low = core.lower()
    ends = word[-1] in ".!?:" or word[-2:-1] in (".", "!", "?")
    if _NUMBER.fullmatch(core):
        return NUMBER, ends, low.replace(",", "")
    kind = EMPTY if not core else UNIT if low in _UNITS else CAPITAL if core[0] != low[0] else LITERAL
    return kind, ends, low or word


def canonical(kind: np.ndarray, ends: np.ndarray, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical hash of each word, and whether it is a placeholder; ``begin`` are the first words of texts."""
    starts = np.ones(len(raw), bool)
    starts[1:] = ends[:-1]
    starts[begin] = True
    number, unit = kind == NUMBER, kind == UNIT
    unit[1:] &= number[:-1]
    unit[begin] = False
    name = (kind == CAPITAL) & ~starts
    h = raw.copy()
    h[number], h[unit], h[name] = _NUM, _UNIT, _NAME
    return h, number | unit | name


class Canon:
    """Kinds and hashes of the words of one text after another, remembered for about ``MEMO`` different ones."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.kind, self.ends, self.raw = np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, np.uint64)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hash of each word, whether it is a placeholder, and the hash of the word itself."""
        if len(self.memo) >= MEMO:
            self.__init__()
        if new := [w for w in dict.fromkeys(words) if w not in self.memo]:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            kind, ends, hashed = zip(*map(reading, new), strict=True)
            self.kind, self.ends = np.append(self.kind, np.array(kind, np.int8)), np.append(self.ends, np.array(ends, bool))
            self.raw = np.append(self.raw, hashes_of(list(hashed)))
        ids = np.array([self.memo[w] for w in words], np.int64)
        raw = self.raw[ids]
        return *canonical(self.kind[ids], self.ends[ids], raw, np.zeros(1, np.int64)), raw


#: Bytes of words that no pattern has to look at: ASCII letters, and the underscore, which is no punctuation.
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True
_ODD = np.zeros(256, bool)
_ODD[[*b"0123456789", *range(128, 256)]] = True
_STOP, _AFTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".!?:"]] = True
_AFTER[[*b".!?"]] = True
_UNIT_HASHES = np.sort(hashes_of(list(dict.fromkeys(UNITS))))


class Lexicon:
    """What ``Canon`` gives, for the words of many rows at once.

    Words of ASCII letters between punctuation are read as arrays of bytes. Others are looked up by their hashes in a
    cache, a place of which keeps the last word that needed it, and read one by one if they are not there.
    """

    def __init__(self):
        self.keys, self.kind, self.ends, self.raw = np.zeros(CACHE, np.uint64), np.zeros(CACHE, np.int8), np.zeros(CACHE, bool), np.zeros(CACHE, np.uint64)

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hash of each word, whether it is a placeholder, and the hash of the word itself."""
        data, start, end = w.data, w.start.copy(), w.end.copy()
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
        ends = _STOP[data[end - 1]]
        ends |= _AFTER[data[end - 2]] & (end - start > 1)
        for at, step, edge in ((start, 1, 0), (end, -1, 1)):  # punctuation at the edges goes
            todo = np.flatnonzero(~_LETTER[data[at - edge]])
            while len(todo):
                at[todo] += step
                todo = todo[start[todo] < end[todo]]
                todo = todo[~_LETTER[data[at[todo] - edge]]]
        empty = start >= end
        start[empty], end[empty] = w.start[empty], w.end[empty]
        raw = w.hashes(True, start, end)
        kind = np.full(len(raw), LITERAL, np.int8)
        first = data[start]
        kind[(first >= 65) & (first <= 90)] = CAPITAL
        kind[_UNIT_HASHES[np.searchsorted(_UNIT_HASHES, raw).clip(max=len(_UNIT_HASHES) - 1)] == raw] = UNIT
        kind[empty] = EMPTY
        count = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_ODD[data], out=count[1:])
        odd = np.flatnonzero(count[w.end] != count[w.start])
        if len(odd):
            key = w.hashes()[odd]
            at = (key >> np.uint64(64 - CACHE.bit_length() + 1)).astype(np.int64)
            kind[odd], ends[odd], raw[odd] = self.kind[at], self.ends[at], self.raw[at]
            miss = np.flatnonzero(self.keys[at] != key)
            if len(miss):
                _, one, each = np.unique(key[miss], return_index=True, return_inverse=True)
                where = odd[miss[one]]
                new, stop, hashed = zip(*(reading(data[a:z].tobytes().decode()) for a, z in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)), strict=True)
                place = at[miss[one]]
                for mine, learned, cache in ((kind, np.array(new, np.int8), self.kind), (ends, np.array(stop, bool), self.ends), (raw, hashes_of(list(hashed)), self.raw)):
                    mine[odd[miss]] = learned[each]
                    cache[place] = learned
                self.keys[place] = key[miss[one]]
        return *canonical(kind, ends, raw, w.off[:-1][np.diff(w.off) > 0]), raw


def slot(word: str) -> str:
    return _EDGES.sub("", word).lower().replace(",", "")


def windows(h: np.ndarray, held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows that have literal words enough."""
    w = gram_hashes(h, n)
    if not len(w):
        return w, np.zeros(0, np.int64)
    c = np.r_[0, np.cumsum(~held)]
    at = np.flatnonzero(c[n:] - c[:-n] >= min(LITERALS, n))
    return w[at], at


@dataclass(frozen=True)
class Windows:
    """Windows of one length, by hash in order: hash, number of the item and place in it; a table of upper bits tells most others apart."""

    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    maybe: np.ndarray

    def of(self, w: np.ndarray) -> np.ndarray:
        """Places in ``w`` of hashes that are here."""
        k = np.flatnonzero(self.maybe[w >> np.uint64(65 - len(self.maybe).bit_length())])
        return k[self.hashes[np.searchsorted(self.hashes, w[k]).clip(max=len(self.hashes) - 1)] == w[k]]

    def where(self, x: np.uint64) -> Iterator[tuple[int, int]]:
        """(number of the item, place) of each window with the hash ``x``."""
        a, z = np.searchsorted(self.hashes, x, "left"), np.searchsorted(self.hashes, x, "right")
        return zip(self.items[a:z].tolist(), self.places[a:z].tolist(), strict=True)


def _windows(found: list[tuple[np.ndarray, int, np.ndarray]]) -> Windows:
    hashes = np.concatenate([x for x, _, _ in found])
    items = np.repeat(np.array([i for _, i, _ in found], np.int64), [len(x) for x, _, _ in found])
    order = np.argsort(hashes, kind="stable")
    bits = max(10, (16 * len(hashes)).bit_length())
    maybe = np.zeros(1 << bits, bool)
    maybe[hashes >> np.uint64(64 - bits)] = True
    return Windows(hashes[order], items[order], np.concatenate([at for _, _, at in found])[order], maybe)


@dataclass(frozen=True)
class Benchmark:
    """Windows of some items, by length (``WINDOW`` and those of shorter items); the items' slots, and whether the first word may be read as a name."""

    canonical: dict[int, Windows]
    exact: dict[int, Windows]  # of the words themselves
    items: list[int]
    slots: list[list[str | None]]
    either: list[bool]


def compiled(rows: list[tuple[int, str]]) -> Benchmark:
    canon = Canon()
    templates, exact = defaultdict(list), defaultdict(list)
    items, slots, either = [], [], []
    for item, text in rows:
        words = split_words(text)
        if not words:
            continue
        h, held, raw = canon(words)
        n = min(WINDOW, len(words))
        grams = gram_hashes(raw, n)
        exact[n].append((grams, len(items), np.arange(len(grams))))
        core = _EDGES.sub("", words[0])
        first = bool(core) and not held[0] and core[0] != core[0].lower()
        readings = [(h, held)]
        if first:  # in a document it may stand behind a word that ends no sentence, and be a name
            other, also = h[:n].copy(), held[:n].copy()
            other[0], also[0] = _NAME, True
            readings.append((other, also))
        if n >= LITERALS:
            for hashes, places in readings:
                x, at = windows(hashes, places, n)
                if len(x):
                    templates[n].append((x, len(items), at))
        items.append(item)
        slots.append([slot(w) if p or first and not i else None for i, (w, p) in enumerate(zip(words, held.tolist(), strict=True))])
        either.append(first)
    return Benchmark({n: _windows(w) for n, w in sorted(templates.items())}, {n: _windows(w) for n, w in sorted(exact.items())}, items, slots, either)


def touched(w: Words, bench: Benchmark, lexicon: Lexicon) -> np.ndarray:
    """The rows of ``w`` that have a window of the benchmark, by hash."""
    h, held, raw = lexicon(w)
    row = w.row_of_word()
    found = []
    for n, known in bench.canonical.items():
        x, at = windows(h, held, n)
        k = known.of(x)
        found.append(at[k][row[at[k]] == row[at[k] + n - 1]])
    for n, known in bench.exact.items():
        at = known.of(gram_hashes(raw, n))
        found.append(at[row[at] == row[at + n - 1]])
    return np.unique(row[np.concatenate(found)]) if found else np.zeros(0, np.int64)


def matched(text: str | None, bench: Benchmark, canon: Canon) -> list[tuple[int, int]]:
    """(item id, number of windows) of each item of which ``text`` has windows with consistent slots."""
    words = split_words(text)
    if not words:
        return []
    h, held, raw = canon(words)
    found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    same: dict[tuple[int, int], set[int]] = defaultdict(set)
    for n, known in bench.canonical.items():
        w, at = windows(h, held, n)
        for k in known.of(w).tolist():
            for item, place in known.where(w[k]):
                found[item, int(at[k]) - place].append((place, n))
    for n, known in bench.exact.items():
        w = gram_hashes(raw, n)
        for k in known.of(w).tolist():
            for item, place in known.where(w[k]):
                same[item, k - place].add(place)
    best: dict[int, int] = {}
    for item, shift in {**found, **same}:
        # Windows of equal words need no slots.
        good = same.get((item, shift), set()) | agreeing(found.get((item, shift), []), bench.slots[item], words, shift, bench.either[item] and not held[shift] if shift >= 0 else False)
        if good:
            best[bench.items[item]] = max(len(good), best.get(bench.items[item], 0))
    return sorted(best.items())


def agreeing(places: list[tuple[int, int]], slots: list[str | None], words: list[str], shift: int, skip: bool) -> set[int]:
    """The windows (place in the item, length) whose slots map one to one, in themselves and along their run.

    A run goes on while windows overlap and agree; ``skip``: the item's first word is no slot here.
    """
    good: set[int] = set()
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    end = -1
    for place, n in places:
        if place > end:
            there, back = {}, {}
        for fresh_run in (False, True):
            if fresh_run:
                there, back = {}, {}
            now, then = dict(there), dict(back)
            pairs = [(slots[i], slot(words[i + shift])) for i in range(place, place + n) if slots[i] is not None and (i or not skip)]
            if all(now.setdefault(a, b) == b and then.setdefault(b, a) == a for a, b in pairs):
                there, back = now, then
                good.add(place)
                break
        end = place + n
    return good


def benchmark_blocks(bench: DataFrame) -> Iterator[Benchmark]:
    """The benchmark, in blocks of ``BLOCK`` words or one item more, which the driver reads one after the other."""
    b = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    rows, words = [], 0
    for r in b.toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        words += len(split_words(r["text"]))
        if words >= BLOCK:
            yield compiled(sorted(rows))
            rows, words = [], 0
    if rows:
        yield compiled(sorted(rows))


def flagged(df: DataFrame, bench: DataFrame, text: str = "text", items: str = "_items", windows: str = "_windows") -> DataFrame:
    """``df`` with two columns more: ``items`` (ids of the items found, in order) and ``windows`` (of all of them)."""
    out = df.withColumn(items, F.array().cast("array<long>")).withColumn(windows, F.lit(0).cast("long"))
    names = df.columns
    at = names.index(text)
    for block in benchmark_blocks(bench):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench, canon, lexicon = shared.value, Canon(), Lexicon()
            for b in batches:
                found, counts, texts = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), b.column(at)
                for w in pieces(texts):
                    for i in (w.first + touched(w, bench, lexicon)).tolist() if bench.items else ():
                        if got := matched(texts[i].as_py(), bench, canon):
                            found[i] = sorted(found[i] + [x for x, _ in got])
                            counts[i] += sum(n for _, n in got)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=[*names, items, windows])

        out = out.mapInArrow(run, out.schema)
    return out


def clean(df: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that hold nothing of the benchmark, with the columns of ``df``."""
    items, windows = fresh(df, "items", "windows")
    return flagged(df, bench, text, items, windows).where(F.size(F.col(f"`{items}`")) == 0).select(*(F.col(f"`{n}`") for n in df.columns))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_windows and item_ids of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return flagged(docs, bench).select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_windows").alias("n_windows"), F.col("_items").alias("item_ids"))
