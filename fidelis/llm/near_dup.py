"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's set of word shingles gives a signature of ``BANDS * ROWS`` minima. Equal sets are one class, a node,
   named by a 64-bit hash of the set; every later step sees nodes alone.
2. Nodes that agree in a whole band are candidates. A band's members are not paired with each other but with one hub, the
   member that shares most bands with others (in a group of copies, the one nearest to all), and each node is verified
   against its best hub only: one pair a node, which joins most of what belongs together.
3. Bands that still hold members of different components are compared inside the tasks. The members of a band's largest
   component are dealt to blocks once; the others, few as a rule, are sent to each of these blocks. Pairs of signatures
   are compared batch by batch; after each batch a pair is pruned if the posterior probability of a similarity at or
   above the threshold, given the agreements so far under a uniform prior, is below ``MISS``. A pair that agrees in
   several bands counts in the first of them. No pair leaves the task: a member with a surviving pair does.
4. The surviving members of a block get their full sets, and the block's intersections are counted exactly, as one matrix
   product over the shingles that two of them hold at least. A task writes out a spanning forest of its verified links,
   fewer rows than members. So all candidates are verified, and nothing written grows with the pairs.
5. Verified links are contracted to components, round by round, until none is left between two components.

Miss probabilities: a pair at the threshold 0.8 shares no band with probability (1 - 0.8**5)**30 = 7e-6; pruning adds at
most ``MISS`` a batch. Shingles are compared by 64-bit hashes, minima by 16 bits of theirs, which may add candidates.

Special input: a null or empty text, or one without words, has the empty set and is linked with nothing; a text with
fewer words than a shingle has its whole sequence as one. Every row is a document: rows that repeat a doc_id are judged
each by its own text, and those that repeat the text too stay or go together. A row without a doc_id can't be named by a
component: it takes no part, has the component null, and is kept. An empty table gives an empty result; long texts are
taken whole; other columns, whatever their names, are not looked at by ``components`` and are passed on by
``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.store import Scratch
from fidelis.llm.text import Words, mix, pieces, signed

BANDS, ROWS = 30, 5
#: Agreements are looked at in batches of so many minima; chance of pruning a pair at the threshold, in each batch.
BATCH, MISS = 25, 1e-6
#: Members of one block of a band, and shingles of all of them; a larger band makes more blocks.
BLOCK, SHINGLES = 1000, 4_000_000
#: Signatures that are compared with a block at once, and shingles that one matrix holds.
CHUNK, COLUMNS = 100, 4096

_rng = np.random.Generator(np.random.PCG64(77))
_FACTOR = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_FOLD = np.uint32(0x9E3779B1)


def shingles_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows of ``w``, as they come, and where each row's begin (one more for the end)."""
    words = w.hashes(lower=True)
    size = np.diff(w.off)
    grams, at = w.grams(words, k)
    off = np.searchsorted(at, w.off)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):  # a row's whole sequence is its one shingle
        whole = [np.bitwise_xor.reduce(mix(words[a:z] + np.arange(1, z - a + 1, dtype=np.uint64))) + np.uint64(z - a) for a, z in zip(w.off[short], w.off[short + 1])]
        grams = np.insert(grams, off[short], mix(np.array(whole, np.uint64)))
        off = off + np.searchsorted(short, np.arange(len(off)))
    return grams, off


def signatures(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The minima, folded to 16 bits, of each row with shingles, in order."""
    first = off[:-1][np.diff(off) > 0]
    out = np.empty((len(first), BANDS * ROWS), np.uint16)
    if len(first):
        x = (grams >> np.uint64(32)).astype(np.uint32)
        h = np.empty_like(x)
        for i in range(BANDS * ROWS):
            np.multiply(x, _FACTOR[i], out=h)
            h += _OFFSET[i]
            out[:, i] = np.minimum.reduceat(h, first) * _FOLD >> np.uint32(16)
    return out


def name_of(distinct: np.ndarray) -> int:
    """The name of a set of shingles, as a signed number."""
    total = np.array([distinct.sum(dtype=np.uint64), mix(distinct).sum(dtype=np.uint64) + np.uint64(len(distinct))])
    return int(signed(mix(total[:1] ^ mix(total[1:])))[0])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (of the text), n (size of the set), node (name of the set) and sig; the last two null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nodes, sig = [], [], []
            for w in pieces(b.column(2)):
                grams, off = shingles_of(w, k)
                signed_rows = iter(signatures(grams, off))
                for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    s = np.unique(grams[a:z])
                    n.append(len(s))
                    nodes.append(name_of(s) if len(s) else None)
                    sig.append(next(signed_rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "th", "n", "node", "sig"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, node long, sig binary")


def sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) of the nodes of ``wanted`` (doc_id, node): sorted shingle hashes, as bytes."""
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, names = [], b.column(0).to_pylist()
            for w in pieces(b.column(1)):
                grams, off = shingles_of(w, k)
                out += [np.unique(grams[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            # A doc_id may stand at several texts; the node tells which one is meant.
            ok = [i for i, s in enumerate(out) if len(s) and name_of(s) == names[i]]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in ok], pa.int64()), pa.array([out[i].tobytes() for i in ok], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def banded(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n) for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(len(b), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(b), BANDS)).copy()
            for r in range(ROWS):
                key = mix(key ^ sig[:, :, r])
            each = [np.repeat(b.column(c).to_numpy(), BANDS) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key.reshape(-1))), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(b))), *map(pa.array, each)], names=["key", "band", "node", "n"])

    return nodes.select("node", "n", "sig").mapInArrow(run, "key long, band byte, node long, n long")


@lru_cache
def least_agreements(percent: int) -> tuple[int, ...]:
    """For each number of batches, the agreements below which P(similarity >= percent / 100) falls under MISS."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above, out = grid >= percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            p = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(p - p.max())
            if p[above].sum() >= MISS * p.sum():
                out.append(m)
                break
    return tuple(out)


def surviving(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures prunes."""
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
    least = least_agreements(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(len(b), -1) for c in (2, 3))
            alive, same = np.arange(len(b)), np.zeros(len(b), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                same = same + (x[alive, part] == y[alive, part]).sum(axis=1)
                ok = same >= m
                alive, same = alive[ok], same[ok]
            got = b.take(pa.array(alive, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    of = lambda x: full.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def met(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, band: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y of different components (rx, ry) whose signatures no batch prunes and first agree in ``band``."""
    grid = np.zeros((len(x), len(y)), np.int8)
    left, right = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for col in range(BATCH):  # the first batch of all pairs at once
        grid += left[col][:, None] == right[col][None, :]
    i, j = np.nonzero((grid >= least[0]) & (rx[:, None] != ry[None, :]))
    same = grid[i, j].astype(np.int16)
    for n, m in enumerate(least[1:], 1):
        for col in range(n * BATCH, (n + 1) * BATCH):
            same += left[col][i] == right[col][j]
        ok = same >= m
        i, j, same = i[ok], j[ok], same[ok]
    ok = np.ones(len(i), bool)
    for early in range(band):  # earlier bands have these pairs if they agree there
        part = slice(early * ROWS, (early + 1) * ROWS)
        ok[ok] = ~(x[i[ok], part] == y[j[ok], part]).all(axis=1)
    return i[ok], j[ok]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with one value in the first column."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != now and held:
                yield held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield held


def blocks(near: DataFrame, root: DataFrame) -> DataFrame:
    """(block, inner, side, band, node, root): the members of bands that hold several components, dealt to blocks.

    Side 0 of a block is compared with side 1 and, if ``inner``, side 1 with itself. Side 0 are members of the band's
    largest component, or others of another block of them.
    """
    placed = near.join(root, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    size = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    total = size.groupBy("key").agg(F.max(F.struct("c", "n", "root")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("c > top.c")
    cuts = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / SHINGLES)).cast("int")
    total = total.select("key", F.col("top.root").alias("top"), cuts(F.col("top.c"), F.col("top.n")).alias("tops"), cuts(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("others"))
    m = placed.join(total, "key").withColumn("deal", F.abs(F.xxhash64("node", "key")))
    deal = lambda of: F.pmod(F.col("deal"), F.col(of)).cast("int")
    at = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    count = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    top = F.transform(count("others"), lambda j: at(deal("tops"), j, 0))
    own = F.transform(count("tops"), lambda i: at(i, deal("others"), 1))
    # Two blocks of others meet under the number -1 - (the lower one).
    higher = F.transform(F.filter(count("others"), lambda j: j > deal("others")), lambda j: at(-1 - deal("others"), j, 0))
    lower = F.transform(F.filter(count("others"), lambda j: j < deal("others")), lambda j: at(-1 - j, deal("others"), 1))
    each = m.withColumn("at", F.explode(F.when(F.col("root") == F.col("top"), top).otherwise(F.concat(own, higher, lower))))
    return each.select(F.xxhash64("key", "at.i", "at.j").alias("block"), (F.col("at.i") == 0).alias("inner"), "at.side", "band", "node", "root")


def pending(dealt: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(block, inner, side, node, root): the members of each block that have a pair which no batch prunes."""
    least = least_agreements(percent)
    rows = dealt.join(nodes.select("node", "sig"), "node").repartition("block").sortWithinPartitions("block").select("block", "inner", "side", "band", "node", "root", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            block, inner, _, band = held[0][:4]
            sig = np.frombuffer(b"".join([r[6] for r in held]), np.uint16).reshape(len(held), -1)
            side, node, root = (np.array([r[c] for r in held]) for c in (2, 4, 5))
            wait = np.zeros(len(held), bool)
            others = np.flatnonzero(side == 1)
            against = np.arange(len(held)) if inner else np.flatnonzero(side == 0)
            for a in range(0, len(others), CHUNK):
                part = others[a : a + CHUNK]
                i, j = met(sig[part], sig[against], root[part], root[against], band, least)
                wait[part[i]] = True
                wait[against[j]] = True
            k = np.flatnonzero(wait)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int64)), pa.array(np.full(len(k), inner)), pa.array(side[k].astype(np.int32)), pa.array(node[k]), pa.array(root[k])], names=["block", "inner", "side", "node", "root"])

    return rows.mapInArrow(run, "block long, inner boolean, side int, node long, root long")


def shared_counts(full: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with all sets, as a matrix product over the shingles of two sets at least."""
    owner = np.repeat(np.arange(len(full)), [len(s) for s in full])
    _, col, times = np.unique(np.concatenate(full), return_inverse=True, return_counts=True)
    of = np.cumsum(times > 1) - 1
    several = times[col] > 1
    owner, col = owner[several], of[col[several]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((len(rows), len(full)), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, z = np.searchsorted(col, (first, first + COLUMNS))
        holds = np.zeros((len(full), min(COLUMNS, int(col[-1]) + 1 - first)), np.float32)
        holds[owner[a:z], col[a:z] - first] = 1
        out += holds[rows] @ holds.T
    return out.astype(np.int64)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links ``pairs`` (rows of two)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def linked(waiting: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that verified links of the blocks join, a spanning forest of each block."""
    rows = waiting.join(full, "node").repartition("block").sortWithinPartitions("block").select("block", "inner", "side", "root", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            side, root = (np.array([r[c] for r in held]) for c in (2, 3))
            full = [np.frombuffer(r[4], np.uint64) for r in held]
            size = np.array([len(s) for s in full])
            rows = np.flatnonzero(side == 1)
            common = shared_counts(full, rows)
            links = (common > 0) & (100 * common >= percent * (size[rows][:, None] + size[None, :] - common)) & (root[rows][:, None] != root[None, :])
            if not held[0][1]:
                links &= (side == 0)[None, :]
            i, j = np.nonzero(links)
            if len(i):
                found = np.sort(np.stack([root[rows[i]], root[j]], axis=1), axis=1)
                a, b = zip(*forest(np.unique(found, axis=0)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def contract(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), root being the smallest node it is connected with; a kept table.

    Each round gives every node the smallest of its neighbours (or itself) as parent, follows parents twice, and keeps
    the links between different parents. A round at least halves the nodes of each component.
    """
    edges = scratch.keep(links.select("a", "b").where("a <> b").distinct())
    roots: DataFrame | None = None
    while edges.limit(1).count():
        ends = edges.union(edges.select("b", "a"))
        parent = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        for _ in range(2):
            ahead = parent.select(F.col("node").alias("up"), F.col("up").alias("further"))
            parent = parent.join(ahead, "up", "left").select("node", F.coalesce("further", "up").alias("up"))
        parent = scratch.keep(parent)
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        before, edges = edges, scratch.keep(edges.join(a, "a").join(b, "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).where("a <> b").distinct())
        if roots is None:
            roots = parent.select("node", F.col("up").alias("root"))
            held = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("up").alias("next"))
            roots = scratch.keep(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            scratch.drop(held, parent)
            held = roots
        scratch.drop(before)
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    scratch.drop(edges)
    return roots


def with_hubs(near: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node and the hub that it meets in most bands; a band's hub is the member with most mates in all bands."""
    popular = near.groupBy("node").agg(F.sum("c").alias("mates"))
    members = near.join(popular, "node").select("key", "node", "mates")
    of = members.groupBy("key").agg(F.max(F.struct("mates", "node")).alias("hub"))
    meets = members.join(of, "key").select("node", F.col("hub.node").alias("hub")).where("node <> hub")
    best = meets.groupBy("node", "hub").count().groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def sketched(df: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of every row of ``df``."""
    scratch = Scratch(df.sparkSession, "near")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.keep(sketches(docs.withColumn("th", F.xxhash64("text")), k))
    nodes = scratch.keep(sketch.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    bands = banded(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    near = scratch.keep(bands.join(shared, "key"))  # bands with two members at least
    full = scratch.keep(sets(docs.where("doc_id IS NOT NULL"), nodes.select(F.col("low").alias("doc_id"), "node").join(near.select("node").distinct(), "node", "left_semi"), k))
    pairs = scratch.keep(surviving(with_hubs(near), nodes, percent))
    root = contract(verified(pairs, full, percent), scratch)
    waiting = scratch.keep(pending(blocks(near, root), nodes, percent))
    scratch.drop(near, pairs)
    last = contract(linked(waiting, full, percent), scratch)
    scratch.drop(waiting, full)
    # From node to root, and on to the root that the second round gave it.
    place = nodes.select("node", "low").join(root, "node", "left").select("low", F.coalesce("root", "node").alias("on"), "node")
    place = place.join(last.select(F.col("node").alias("on"), F.col("root").alias("top")), "on", "left").select("node", "low", F.coalesce("top", "on").alias("top"))
    place = scratch.keep(place)
    lowest = scratch.keep(place.groupBy("top").agg(F.min("low").alias("component"), F.count("*").alias("c")).where("c > 1").select("top", "component"))
    named = scratch.keep(place.join(lowest, "top", "left").select("node", F.coalesce("component", "low").alias("component")))
    lone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = sketch.select("doc_id", "th", "n", "node").join(named, "node", "left")
    out = scratch.keep(out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), lone).alias("component_id")))
    scratch.drop(sketch, nodes, place, lowest, named)
    return out


def components(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    return sketched(df, k, percent).drop("th")


def representatives(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose document is the smallest of its component, and those without a doc_id, with the columns of ``df``."""
    gone = sketched(df, k, percent).where("doc_id <> component_id").select("doc_id", "th").distinct()
    same = (df["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(df["text"].cast("string")) == gone["th"])
    return df.join(gone, same, "left_anti")


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs, 2, 80).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_sql(percent: int = 80) -> str:
    """DuckDB text of the query: all pairs that share a shingle, and the closure of the links."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[k] || ' ' || w[k + 1] ELSE w[1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""
