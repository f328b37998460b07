"""Substring dedup with repeated-phrase automata.

A window is ``n`` consecutive words of one document. A word goes if a window that covers it also starts, word for word,
in a document with a smaller doc_id.

1. Every window has an anchor: of its ``ANCHOR``-word sequences, that with the smallest hash. Equal windows have equal
   anchors, and neighbouring windows mostly share theirs, so few anchors stand for all windows. Anchors that occur in
   two documents at least are found by one aggregation (map-side combined: a phrase that a third of all documents
   share arrives as one row of each task).
2. Each document gets the list of its recurring anchors, and its runs of windows with such anchors are cut out as
   passages, the only text that later steps see. Equal passages are one from here on.
3. Pieces of passages are dealt by anchor to shards. Confirmation: windows that two documents at least have are the
   recurring phrases, each with the smallest doc_id that has it. All windows with one anchor are in one shard, so it
   confirms its own; an anchor with very many pieces is spread over several shards, and its phrases, confirmed by an
   aggregation, are sent to each of them.
4. A shard compiles its phrases, as sequences of word numbers, into Aho-Corasick automata, and all its pieces stream
   through them, which locates every occurrence. A document meets only the shards that hold one of its anchors, so the
   work grows with the text and not with text times shards.
5. Occurrences whose phrase has a smaller doc_id cover words; what is left is put together from the whole text.

Special input: a null or empty text has no words; a text with fewer than ``n`` words loses none. Every row has a row in
the result: a row without a doc_id is neither earlier nor later than any other and loses nothing; rows that repeat a
doc_id are judged each by its own text, and take nothing from each other. An empty table gives an empty result; texts of
any length are taken whole; other columns are not looked at. Texts travel between stages compressed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.store import Scratch
from fidelis.llm.text import Words, gram_hashes, mix, pieces, signed

WINDOW, ANCHOR = 13, 4
#: Documents with an anchor up to which it is kept in one shard; for more, its pieces are dealt to several.
PIECES = 2000
#: Parts of a shard whose automata are built one after the other.
PARTS = 16


def anchors_of(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and first word of each window of the rows of ``w``."""
    k = min(ANCHOR, n)
    g = gram_hashes(w.hashes(), k)
    wide = 1
    while 2 * wide <= n - k + 1:  # the smallest of twice as many sequences each time
        g = np.minimum(g[:-wide], g[wide:])
        wide *= 2
    if more := n - k + 1 - wide:
        g = np.minimum(g[:-more], g[more:])
    row = w.row_of_word()
    at = np.flatnonzero(row[: len(g)] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    return g[at], at


def runs(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a new anchor or a new row begins; one more for the end."""
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return np.append(np.flatnonzero(new), len(h))


def document_anchors(docs: DataFrame, n: int) -> DataFrame:
    """(h, doc_id): the anchors of each document, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in pieces(b.column(1)):
                h, at = anchors_of(w, n)
                row = w.row_of_word()[at]
                first = runs(h, row)[:-1]
                h, row = h[first], row[first]
                order = np.lexsort((h, row))
                first = order[runs(h[order], row[order])[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(ids[w.first + row[first]])], names=["h", "doc_id"])

    return docs.mapInArrow(run, "h long, doc_id long")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, th (of the text) and z, the words joined by blanks, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out = []
            for w in pieces(b.column(1)):
                raw, at = w.joined()
                out += [z.compress(raw[x:y]) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["doc_id", "th", "z"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, z binary")


def unpacked(z: list[bytes]) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) for x in z], pa.large_binary()).cast(pa.large_string())


def passages(texts: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, start, passage, hot, shards): runs of words that lie in windows with a recurring anchor, compressed.

    ``hot`` has those of its anchors that need several shards, in order, and ``shards`` how many each.
    """
    both = texts.join(known, "doc_id").select("doc_id", "z", "known", "hot", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches:
            all_ids, all_th, known = b.column(0).to_numpy(), b.column(4).to_numpy(), b.column(2)
            size = known.value_lengths().to_numpy()
            salt = mix(np.arange(len(b), dtype=np.uint64))
            wanted = np.sort(known.flatten().to_numpy().view(np.uint64) ^ np.repeat(salt, size))  # anchors, told apart by document
            wide = [{x["h"]: x["shards"] for x in hot} for hot in b.column(3).to_pylist()]
            ids, th, starts, texts, hots, shards = [], [], [], [], [], []
            for w in pieces(unpacked(b.column(1).to_pylist())):
                h, at = anchors_of(w, n)
                row = w.row_of_word()[at]
                own = h ^ salt[w.first + row]
                ok = wanted[np.searchsorted(wanted, own).clip(max=len(wanted) - 1)] == own
                h, at, row = h[ok], at[ok], row[ok]
                edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, np.int64)
                last = np.append(edge[1:], len(at)) - 1
                for a, z, r in zip(edge.tolist(), last.tolist(), row[edge].tolist(), strict=True):
                    many = wide[w.first + r]
                    got = sorted({x for x in signed(h[a : z + 1]).tolist() if x in many}) if many else []
                    hots.append(got)
                    shards.append([many[x] for x in got])
                ids += all_ids[w.first + row[edge]].tolist()
                th += all_th[w.first + row[edge]].tolist()
                starts += (at[edge] - w.off[row[edge]]).tolist()
                raw = w.data.tobytes()
                texts += [c.compress(raw[x:y]) for x, y in zip(w.start[at[edge]].tolist(), w.end[at[last] + n - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(starts, pa.int32()), pa.array(texts, pa.binary()), pa.array(hots, pa.list_(pa.int64())), pa.array(shards, pa.list_(pa.int32()))], names=["doc_id", "th", "start", "passage", "hot", "shards"])

    return both.mapInArrow(run, "doc_id long, th long, start int, passage binary, hot array<long>, shards array<int>")


def lists_of(b: pa.RecordBatch) -> list[list]:
    """The columns of a batch, which hold no nulls and no lists, as Python lists."""
    return [c.to_numpy(zero_copy_only=False).tolist() for c in b.columns]


def cut_at_anchors(distinct: DataFrame, n: int) -> DataFrame:
    """(h, pid, off, piece, low, high, shards): each run of a passage's windows with one anchor, as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.select(["pid", "low", "high"])
            wide = {i: dict(zip(hot, each, strict=True)) for i, (hot, each) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)) if hot}
            for w in pieces(unpacked(b.column(1).to_pylist())):
                h, at = anchors_of(w, n)
                row = w.row_of_word()[at]
                edge = runs(h, row)
                first, last = edge[:-1], edge[1:] - 1
                raw = w.data.tobytes()
                texts = [raw[x:y] for x, y in zip(w.start[at[first]].tolist(), w.end[at[last] + n - 1].tolist(), strict=True)]
                off = (at[first] - w.off[row[first]]).astype(np.int32)
                of = w.first + row[first]
                shards = np.ones(len(of), np.int32)
                if wide:
                    for i in np.flatnonzero(np.isin(of, list(wide))).tolist():
                        shards[i] = wide[int(of[i])].get(int(signed(h[first[i] : first[i] + 1])[0]), 1)
                got = ends.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), got.column(0), pa.array(off), pa.array(texts, pa.binary()).cast(pa.string()), got.column(1), got.column(2), pa.array(shards)], names=["h", "pid", "off", "piece", "low", "high", "shards"])

    return distinct.select("pid", "passage", "low", "high", "hot", "shards").mapInArrow(run, "h long, pid long, off int, piece string, low long, high long, shards int")


def windows_of(segments: DataFrame, n: int) -> DataFrame:
    """(h, phrase, low, high, shards): the windows of all pieces with the smallest and largest doc_id of their passages, each about once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, phrase, *ends) for (h, phrase), ends in found.items()]
            found.clear()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "phrase", "low", "high", "shards"])

        for b in batches:
            for h, text, low, high, shards in zip(*lists_of(b), strict=True):
                words = text.split(" ")
                for k in range(len(words) - n + 1):
                    key = h, " ".join(words[k : k + n])
                    if ends := found.get(key):
                        ends[:2] = min(low, ends[0]), max(high, ends[1])
                    else:
                        found[key] = [low, high, shards]
            if len(found) >= 50_000:
                yield out()
        yield out()

    return segments.select("h", "piece", "low", "high", "shards").mapInArrow(run, "h long, phrase string, low long, high long, shards int")


def candidates(texts: list[str], low: list[int], shared: list[bool], n: int) -> dict[int, list[int]]:
    """By number of the text: where its windows start that two documents at least have, judged by 64-bit hashes, so with all that do."""
    h, rows, at = [], [], []
    for w in pieces(pa.array(texts, pa.string())):
        g, first = w.grams(w.hashes(), n)
        row = w.row_of_word()[first]
        h.append(g)
        rows.append(w.first + row)
        at.append(first - w.off[row])
    if not h:
        return {}
    h, rows, at = (np.concatenate(x) for x in (h, rows, at))
    if not len(h):
        return {}
    order = np.argsort(h, kind="stable")
    rows, at, h = rows[order], at[order], h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    lows, many = np.array(low)[rows], np.array(shared)[rows]
    several = np.logical_or.reduceat(many, first) | (np.minimum.reduceat(lows, first) < np.maximum.reduceat(lows, first))
    several = np.repeat(several, np.diff(np.append(first, len(h))))
    out: dict[int, list[int]] = {}
    for row, k in zip(rows[several].tolist(), at[several].tolist(), strict=True):
        out.setdefault(row, []).append(k)
    return out


class Automaton:
    """Phrases as sequences of word numbers, each with the smallest doc_id that has it."""

    def __init__(self, n: int):
        self.n = n
        self.number: dict[str, int] = defaultdict(count(1).__next__)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.made = False

    def numbers(self, text: str) -> tuple[int, ...]:
        return tuple(map(self.number.__getitem__, text.split(" ")))

    def add(self, phrase: tuple[int, ...], first: int) -> None:
        self.tree.add_word(phrase, first)

    def confirm(self, rows: Iterable[tuple[tuple[int, ...], int, bool, list[int]]]) -> None:
        """Adds the windows of ``rows`` (piece, smallest doc_id, whether there are more, windows to look at) that two documents at least have."""
        n = self.n
        low: dict[tuple[int, ...], int] = {}
        several: set[tuple[int, ...]] = set()
        for piece, a, shared, places in rows:
            for k in places:
                w = piece[k : k + n]
                before = low.setdefault(w, a)
                if shared or before != a:
                    several.add(w)
                    if a < before:
                        low[w] = a
        add = self.tree.add_word
        for w in several:
            add(w, low[w])

    def occurrences(self, piece: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """Runs (place of the first phrase's first word, number of phrases, smallest doc_id) of the phrases in ``piece``."""
        if not len(self.tree):
            return []
        if not self.made:
            self.tree.make_automaton()
            self.made = True
        out: list[tuple[int, int, int]] = []
        for end, first in self.tree.iter(piece):
            at = end - self.n + 1
            if out and first == out[-1][2] and at == out[-1][0] + out[-1][1]:
                out[-1] = (out[-1][0], out[-1][1] + 1, first)
            else:
                out.append((at, 1, first))
        return out


def located(segments: DataFrame, n: int) -> DataFrame:
    """(pid, offs, counts, firsts): runs of places in the passage where recurring phrases with one smallest doc_id start."""
    shard = F.pmod(F.xxhash64("pid", "off"), F.col("shards")).cast("int")
    to = lambda shard: F.pmod(F.xxhash64("h", shard), F.lit(2**31 - 1)).cast("int").alias("to")
    shared = (F.col("low") < F.col("high")).alias("shared")
    rows = segments.select(to(shard), F.when(F.col("shards") == 1, 1).otherwise(2).cast("byte").alias("kind"), F.col("piece").alias("words"), "low", shared, "pid", "off")
    # Anchors whose pieces are in several shards: their phrases go to each.
    phrases = windows_of(segments.where("shards > 1"), n).groupBy("h", "phrase", "shards").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    each = phrases.withColumn("each", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.union(each.select(to(F.col("each")), F.lit(0).cast("byte"), "phrase", "low", F.lit(True), F.lit(0).cast("long"), F.lit(0)))
    rows = rows.repartition("to").withColumn("part", F.pmod("to", F.lit(PARTS))).sortWithinPartitions("part", "kind").select("part", "kind", "words", "low", "shared", "pid", "off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, automaton = None, Automaton(n)
        # Pieces of one part whose phrases aren't confirmed yet: smallest doc_id, whether several documents have them, and where they stand.
        waiting: dict[str, list] = {}
        seen: dict[str, list[tuple[int, int, int]]] = {}
        found: tuple[list, ...] = ([], [], [], [])

        def locate(runs: list[tuple[int, int, int]], pid: int, off: int) -> None:
            if runs:
                offs, counts, firsts = zip(*runs, strict=True)
                for x, y in zip(found, (pid, [off + at for at in offs], counts, firsts), strict=True):
                    x.append(y)

        def confirmed() -> None:
            texts = list(waiting)
            maybe = candidates(texts, [x[0] for x in waiting.values()], [x[1] for x in waiting.values()], n)
            # The other pieces hold no recurring window: phrases of kind 0 have anchors of their own.
            held = [(automaton.numbers(texts[k]), *waiting[texts[k]], at) for k, at in maybe.items()]
            automaton.confirm((piece, low, shared, at) for piece, low, shared, _, at in held)
            for piece, _, _, places, _ in held:
                runs = automaton.occurrences(piece)
                for pid, off in places:
                    locate(runs, pid, off)
            waiting.clear()

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=["pid", "offs", "counts", "firsts"])
            for x in found:
                x.clear()
            return batch

        for b in batches:
            for now, kind, words, low, shared, pid, off in zip(*lists_of(b), strict=True):
                if now != part:
                    confirmed()
                    part, automaton = now, Automaton(n)
                    seen.clear()
                if kind == 0:
                    automaton.add(automaton.numbers(words), low)
                elif kind == 1:
                    if (held := waiting.get(words)) is None:
                        waiting[words] = [low, shared, [(pid, off)]]
                    else:
                        held[1] = held[1] or shared or low != held[0]
                        held[0] = min(low, held[0])
                        held[2].append((pid, off))
                else:
                    if waiting:
                        confirmed()
                    if words not in seen:
                        seen[words] = automaton.occurrences(automaton.numbers(words))
                    locate(seen[words], pid, off)
            yield out()
        confirmed()
        yield out()

    def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # very many tuples, no cycles: collections would only walk them
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return rows.mapInArrow(uncollected, "pid long, offs array<int>, counts array<int>, firsts array<long>")


def covered(docs: DataFrame, texts: DataFrame, scratch: Scratch, n: int = WINDOW) -> DataFrame:
    """(doc_id, own): for each doc_id whose rows lose words, by text (th) the runs (at, n) of windows that an earlier document has; a kept table."""
    anchors = scratch.keep(document_anchors(docs, n))
    recurring = scratch.keep(anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("h", F.ceil(F.col("n") / PIECES).cast("int").alias("shards")))
    wide = F.when(F.col("shards") > 1, F.struct("h", "shards"))
    known = anchors.join(recurring, "h").groupBy("doc_id").agg(F.collect_list("h").alias("known"), F.collect_list(wide).alias("hot"))  # bounded by the document
    found = scratch.keep(passages(texts, known, n).withColumn("pid", F.xxhash64("passage")))
    scratch.drop(anchors, recurring)
    # Passages with equal words are one, named by a 64-bit hash of their words.
    distinct = found.groupBy("pid").agg(F.first("passage").alias("passage"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("hot").alias("hot"), F.first("shards").alias("shards"))
    segments = scratch.keep(cut_at_anchors(distinct, n))
    hits = scratch.keep(located(segments, n).groupBy("pid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("offs", "counts", "firsts"))))  # bounded by the passage
    hit = F.arrays_zip("offs", "counts", "firsts")
    earlier = F.transform(F.filter(hit, lambda x: x["firsts"] < F.col("doc_id")), lambda x: F.struct((x["offs"] + F.col("start")).alias("at"), x["counts"].alias("n")))
    places = found.select("doc_id", "th", "start", "pid").join(hits, "pid").select("doc_id", "th", earlier.alias("places")).where(F.size("places") > 0)
    out = scratch.keep(places.groupBy("doc_id").agg(F.collect_list(F.struct("th", "places")).alias("own")))  # bounded by the document
    scratch.drop(found, segments, hits)
    return out


def kept_words(words: list[str], places: list[dict], n: int) -> list[str]:
    """``words`` without those that the windows of ``places`` (runs: first window, number of windows) cover."""
    gone = np.zeros(len(words) + 1, np.int64)
    at, count = (np.array([p[k] for p in places], np.int64) for k in ("at", "n"))
    np.add.at(gone, at, 1)
    np.add.at(gone, at + count + n - 1, -1)
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def deduplicated(df: DataFrame, n: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by blanks) of every row."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    z = packed(named).where("doc_id IS NOT NULL")  # as the inner join inside asks for, so that both joins share one shuffle
    lone = packed(docs.where("doc_id IS NULL"))
    both = z.join(covered(named, z, Scratch(df.sparkSession, "substrings"), n), "doc_id", "left").select("doc_id", "th", "z", "own")
    both = both.union(lone.withColumn("own", F.lit(None).cast(both.schema["own"].dataType)))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, shas, kept = [], [], [], []
            for th, raw, own in zip(b.column(1).to_pylist(), unpacked(b.column(2).to_pylist()).to_pylist(), b.column(3).to_pylist(), strict=True):
                places = [p for x in own or () if x["th"] == th for p in x["places"]]
                total, lost = raw.count(" ") + 1 if raw else 0, 0
                if places:
                    left = kept_words(raw.split(" "), places, n)
                    lost = total - len(left)
                    raw = " ".join(left)
                counts.append(total)
                gone.append(lost)
                shas.append(hashlib.sha256(raw.encode()).hexdigest())
                kept.append(raw)
            out = [b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * texts, names=names)

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op4_sql(n: int = WINDOW) -> str:
    """DuckDB text of the query: windows as lists of words, and the smallest doc_id that has each."""
    return f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, k, md5(array_to_string(w[k + 1 : k + {n}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS k FROM d WHERE len(w) >= {n})
), first AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT g.doc_id, list(DISTINCT g.k + j.j) AS gone FROM g JOIN first USING (g), (SELECT unnest(range(1, {n + 1})) AS j) j WHERE first.low < g.doc_id GROUP BY g.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""
