"""Line dedup by pairwise alignment.

1. Every line with words gives a hash. A document is reduced to the lines that others hold too; of documents with the
   same reduced lines only the first is compared, as the others share all their runs with it.
2. The two documents of a pair are aligned by patience diff on their line hashes: equal heads and tails are taken off,
   lines that are unique in both are anchors, the longest run of anchors in the order of both is kept, and each gap
   between them is aligned alike, by itself; a gap without anchors by a longest common subsequence.
3. Runs of aligned lines with at least ``MIN_WORDS`` words are common blocks. Their lines are deleted from the later
   document; blocks are judged on the input, not on what other pairs have left.

4. Candidates come from windows: shortest runs of lines with ``MIN_WORDS`` words. A document is aligned with the first
   holder of each of its windows, then, for windows that still hold a line, with more of their earlier holders, and at
   last with all of them. So the result is that of an alignment with every earlier document, and pairs grow with the
   square of a window's holders only where lines stay.

Only line hashes and numbers are joined; texts are shuffled once, when lines are deleted. Lines are compared whole, by
64-bit hashes of their words.

Special input: a null text has no lines and stays null; lines without words are neither matched nor deleted; rows
without a doc_id are left out of the alignment and lose nothing; of rows that repeat a doc_id the smallest text counts
for the alignment, and only rows with that text (told by its hash) lose lines; an empty table gives an empty result; texts of any length are taken whole; columns of other names are passed on untouched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.store import Scratch, fresh, keyed
from fidelis.llm.text import mix, pieces, signed

MIN_WORDS = 5
#: Bits that the trace of a common subsequence may hold at once; beyond, the lists are halved.
TRACE = 1 << 27
#: Earlier holders of a window that a document with lines left is aligned with in each round; the last takes all of them.
ROUNDS = (1, 32, 0)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (of the text), hashes and words of its lines; the hash of a line without words is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts, ids = [], [], b.column(0)
            for text in b.column(1).to_pylist():
                lines = text.split("\n") if text else []
                h, n = np.zeros(len(lines), np.uint64), np.zeros(len(lines), np.int32)
                for w in pieces(pa.array(lines, pa.string())) if lines else ():
                    words = w.hashes()
                    size = np.diff(w.off)
                    full = np.flatnonzero(size)
                    if len(full):
                        within = np.arange(len(words)) - np.repeat(w.off[:-1], size)
                        h[w.first + full] = mix(np.add.reduceat(mix(words + within.astype(np.uint64)), w.off[full])) | np.uint64(1)
                        n[w.first : w.first + len(size)] = size
                hashes.append(signed(h))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "th", "h", "n"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, h array<long>, n array<int>")


def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one after the other, so that only one row's arrays are held as Python numbers."""
    for i in range(len(b)):
        yield tuple(c[i].as_py() for c in b.columns)


def rising(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of the items that are unique in both lists, in their longest common order."""
    once_a, once_b = Counter(a), Counter(b)
    where = {x: i for i, x in enumerate(a) if x and once_a[x] == 1}
    anchors = [(where[x], j) for j, x in enumerate(b) if x in where and once_b[x] == 1]
    # Longest rising run of places in a: smallest last place of each length, with back pointers.
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(anchors)
    for k, (i, _) in enumerate(anchors):
        n = bisect_left(tops, i)
        tops[n:n + 1] = [i]
        at[n:n + 1] = [k]
        back[k] = at[n - 1] if n else -1
    run = []
    k = at[-1] if at else -1
    while k >= 0:
        run.append(anchors[k])
        k = back[k]
    return run[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of ``a``, the columns of ``b``, as bits, at which the length of the common subsequence doesn't grow."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        if x:
            at[x] = at.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; zeros match nothing."""
    if len(a) > 1 and len(a) * len(b) > TRACE:  # halve the first list where the lengths of both sides add up to most
        half = len(a) // 2
        k = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return common(a[:half], b[:k]) + [(i + half, j + k) for i, j in common(a[half:], b[k:])]
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal items, rising in both lists.

    Equal heads and tails go first; what is between is cut at its unique anchors, and each gap is treated alike, with
    uniqueness judged inside it. A gap without anchors gets a longest common subsequence. Zeros match nothing.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j] and a[i]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1] and a[i_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        x, y = a[i:i_end], b[j:j_end]
        both = set(x) & set(y)
        if not both - {0}:
            continue
        if run := rising(x, y):
            out += [(i + p, j + q) for p, q in run]
            edges = [(-1, -1), *run, (len(x), len(y))]
            todo += [(i + p + 1, i + r, j + q + 1, j + s) for (p, q), (r, s) in zip(edges, edges[1:])]
        else:  # only items of both sides can match
            keep_x, keep_y = ([k for k, v in enumerate(side) if v and v in both] for side in (x, y))
            out += [(i + keep_x[p], j + keep_y[q]) for p, q in common([x[k] for k in keep_x], [y[k] for k in keep_y])]
    return sorted(out)


def blocks(matches: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Places in the second list that lie in runs of matches with at least ``least`` words."""
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(matches):
        run.append(j)
        if k + 1 == len(matches) or matches[k + 1] != (i + 1, j + 1):
            if sum(words[x] for x in run) >= least:
                out += run
            run = []
    return out


def reduced(lines: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """doc_id, th, and s, n, at: hashes, words and numbers of its lines that another document holds, and a 0 for whatever is between.

    Documents of equal ``s``, which ``sig`` tells, are aligned alike with any other. Those without ``least`` words in a
    row are left out, as they neither lose nor take a line.
    """
    flat = lines.select("doc_id", F.explode(F.array_distinct("h")).alias("line")).where("line <> 0")
    # A table of its own: the join below then reads both sides as they were dealt, and a hot line's rows can be split.
    shared = scratch.keep(flat.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("line"))
    known = flat.join(shared, "line").groupBy("doc_id").agg(F.collect_list("line").alias("known"))  # bounded by the document's lines
    schema = "doc_id long, th long, sig binary, s array<long>, n array<int>, at array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, h, n, known in rows_of(b):
                known, out = set(known), []
                for i, x in enumerate(h):
                    if x in known:
                        out.append((x, n[i], i))
                    elif not out or out[-1][0]:
                        out.append((0, 0, i))
                s, words, at = ([o[k] for o in out] for k in range(3))
                if whole_runs(s, words, least):
                    rows.append((doc, th, hashlib.sha256(np.array(s, np.int64).tobytes()).digest(), s, words, at))
            yield pa.RecordBatch.from_pylist([dict(zip(SIGNED.names, r, strict=True)) for r in rows], schema=SIGNED)

    return lines.join(known, "doc_id").select("doc_id", "th", "h", "n", "known").mapInArrow(run, schema)


SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("sig", pa.binary()), ("s", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))])


def whole_runs(s: list[int], n: list[int], least: int) -> list[int]:
    """Places in runs of lines that aren't 0 with at least ``least`` words."""
    here = [i for i, x in enumerate(s) if x]
    return blocks([(i, i) for i in here], n, least)


def windows(s: list[int], n: list[int], least: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs of lines with ``least`` words that have fewer without their first or without their last line.

    A common run of ``least`` words has each of its lines in a common window.
    """
    out, a, words = set(), 0, 0
    for e, x in enumerate(s):
        if not x:
            a, words = e + 1, 0
            continue
        words += n[e]
        while words - n[a] >= least and a < e:
            words -= n[a]
            a += 1
        if words >= least:
            out.add((a, e + 1))
    b, words = len(s), 0
    for i in range(len(s) - 1, -1, -1):
        if not s[i]:
            b, words = i, 0
            continue
        words += n[i]
        while words - n[b - 1] >= least and b - 1 > i:
            words -= n[b - 1]
            b -= 1
        if words >= least:
            out.add((i, b))
    return sorted(out)


def untested(reps: DataFrame, found: DataFrame | None, least: int) -> DataFrame:
    """(doc_id, w): hashes of the windows of each document that hold a line which isn't deleted."""
    source = reps.select("doc_id", "s", "n", F.array().cast("array<int>").alias("gone")) if found is None else reps.join(found, "doc_id", "left").select("doc_id", "s", "n", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for doc, s, n, gone in rows_of(b):
                gone = set(gone or ())
                left = {hash(tuple(s[i:j])) for i, j in windows(s, n, least) if not gone.issuperset(range(i, j))}
                ids += [doc] * len(left)
                out += left
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["doc_id", "w"])

    return source.mapInArrow(run, "doc_id long, w long")


def aligned(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(doc_id, gone): the places that each document of ``pairs`` (first, doc_id) shares with its earlier one."""
    earlier = reps.select(F.col("doc_id").alias("first"), F.col("s").alias("s1"))
    both = pairs.join(reps, "doc_id").join(earlier, "first").select("doc_id", "s1", "s", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, gone = [], []
            for doc, s1, s, n in rows_of(b):
                if found := blocks(patience(s1, s), n, least):
                    ids.append(doc)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "gone"])

    return both.mapInArrow(run, "doc_id long, gone array<int>")


def deletions(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): the numbers, from 0, of the lines that each document loses, and the hash of the text they were counted in."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(line_table(docs))
    runs = scratch.keep(reduced(lines, least, scratch))
    scratch.drop(lines)
    firsts = runs.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    reps = scratch.keep(runs.join(firsts, "doc_id", "left_semi"))
    held = scratch.keep(untested(reps, None, least))
    several = scratch.keep(held.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "first"))
    before, held = held, scratch.keep(held.join(several, "w"))
    scratch.drop(before)
    left, found = held, None
    for spread in ROUNDS:
        left = left.where("first < doc_id")
        if spread == 1:
            near = left.select("doc_id", "w", "first")
        else:
            near = held.where("first < doc_id").select("w", F.col("doc_id").alias("next")).join(left.select("w").distinct(), "w", "left_semi")
            if spread:
                near = near.groupBy("w", F.pmod(F.xxhash64("next"), F.lit(spread))).agg(F.min("next").alias("next"))
            near = left.select("doc_id", "w").join(near.select("w", F.col("next").alias("first")), "w").where("first < doc_id")
        new = aligned(near.select("first", "doc_id").distinct(), reps, least)
        both = new if found is None else found.unionByName(new)
        before, found = found, scratch.keep(both.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))  # bounded by the document's lines and partners
        if before is not None:
            scratch.drop(before)
        if not spread:
            break
        left = scratch.keep(untested(reps, found, least).join(several, "w"))
        if left.where("first < doc_id").isEmpty():
            break
    # A document that is reduced to the same as an earlier one shares all its runs with it.
    again = runs.join(firsts, "doc_id", "left_anti").select("doc_id", "th", "s", "n", "at", F.lit(None).cast("array<int>").alias("gone"))
    once = reps.join(found, "doc_id").select("doc_id", "th", "s", "n", "at", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for s, n, at, gone in rows_of(b.select(["s", "n", "at", "gone"])):
                out.append([at[k] for k in (whole_runs(s, n, least) if gone is None else gone)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])

    out = scratch.keep(again.unionByName(once).mapInArrow(run, "doc_id long, th long, gone array<int>"))
    scratch.drop(*(t for t, _ in list(scratch.paths.values()) if t is not out))
    return out


def without_lines(text, gone):
    """Expression: ``text`` without the lines whose numbers are in ``gone`` (null: none)."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))


def deduplicated(df: DataFrame, least: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """``df`` with the deleted lines gone from ``text``, and ``n_chars``, if it is there, counted anew."""
    docs = keyed(df, "doc_id", text).withColumnRenamed(text, "text")
    doc, th, gone, new = fresh(df, "doc", "th", "gone", "new")
    lost = deletions(docs, least).withColumnsRenamed({"doc_id": doc, "th": th, "gone": gone})
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col(text).cast("string")) == F.col(th))
    out = df.join(lost, same, "left").withColumn(new, without_lines(F.col(text), F.col(gone)))
    put = {text: F.col(new).alias(text)}
    if "n_chars" in df.columns:
        put["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(df.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(put.get(n, F.col(f"`{n}`")) for n in df.columns))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the lines left of every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lost = deletions(keyed(docs)).withColumnsRenamed({"doc_id": "doc"})
    out = docs.join(lost, (F.col("doc_id") == F.col("doc")) & (F.xxhash64("text") == F.col("th")), "left")
    left = without_lines(F.coalesce("text", F.lit("")), F.col("gone"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.encode(left, "UTF-8"), 256).alias("kept_sha256"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
