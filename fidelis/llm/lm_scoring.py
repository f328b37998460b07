"""Scoring by a log-bilinear language model that is trained with noise-contrastive estimation in numpy.

Tokens: A-Z lowered, words, then one end token a document.

1. Counts of all tokens of all training documents are aggregated exactly (word hashes of 64 bits; map-side combined).
2. The most frequent tokens are the model's own words, ``4 * sqrt(training tokens)`` of them and ``FREQUENT`` at most, so
   that what all executors get has a bound; all other words are the tail. Own words are cut by frequency into about as
   many classes as a class has words.
3. The log-bilinear model makes a vector of the last two tokens, each through its own matrix, and predicts the class of
   the next token and then the word in the class by inner products. It is trained against noise (from the distribution
   of the classes, and even in a class, whose words are about as frequent); nothing is normalised in training.
4. Every token of every training document is an example, none is drawn. Each task trains a copy of its own on all its
   tokens, in two rounds: first the texts whose hash is divisible by ``EVERY``, then, from the mean of the copies, all
   others. Equal examples of a chunk are one with a weight. The copies' rows are averaged, weighted by how often each was
   trained, in two stages that hold one block of rows at a time. A corpus of ``FIRST`` tokens at most is trained on, as
   a whole, by the driver.
5. Scoring is one pass over whole texts. Batched matrix products give the normalised log-probabilities of the class and
   of the word in its class, once for equal contexts and words. A word of the tail gets the probability of the tail in
   its context times its own smoothed share of the tail, so the probabilities of all words sum to 1 (all unseen words
   together count as one word).
6. Tokens that aren't among the ``FREQUENT`` are joined with the table of counts, a row for each in a document; rows of one
   word, seen or not, can be split, as both sides of the join are tables.

Special input: a null or empty text is its end token alone; every row is scored, rows that repeat a doc_id each by its own
text; rows without a doc_id are not learnt from and count as held out; without training documents counts are 0 and all
classes are equally likely; an empty table gives an empty result; texts of any length are taken whole; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.store import Scratch
from fidelis.llm.text import PIECE, mix, pieces, signed

FREQUENT, FOLDS = 65_536, 10
#: Added to each count.
SMOOTH = 0.1
DIMENSIONS, CLASS_NOISE, WORD_NOISE = 16, 32, 8
#: Training tokens up to which the driver trains on them all; for more, one text in so many is in the first round, the others in the second.
FIRST, EVERY = 400_000, 8
RATE = 0.2
#: Weighted examples of a step in the first round and in the second, tokens whose equal examples are joined, and weight of an example.
BATCH, LATER_BATCH, CHUNK, HEAVY = 512, 4096, 1 << 18, 4
#: Training tokens of a round for which a copy is worth its while: there is one for so many of them at most, and one a task.
COPY = 2_000_000
#: Rows of the model that are averaged together, parts that a block's copies are first summed in at most, and contexts that are normalised together.
ROWS, PARTS, CONTEXTS = 1024, 16, 1024
#: Bytes of texts that are scored at once.
TEXTS = 1 << 20
#: Hash of the end token; words are never hashed to it but by chance.
END = int(signed(mix(np.array([0xE0D], np.uint64)))[0])


def fold():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(0))


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                h = [w.hashes(lower=True) for w in pieces(b.column(0))]
                keys, n = np.unique(np.concatenate(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(signed(keys), END)), pa.array(np.append(n, len(b)).astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Counts:
    total: int  # N
    distinct: int  # V
    frequent: np.ndarray  # hashes of the words whose counts all executors get, in order
    counts: np.ndarray
    rank: np.ndarray  # of each of them by frequency
    own: int  # own words of the model: ranks below this

    @property
    def width(self) -> int:
        """Words of a class."""
        return max(1, round(self.own**0.5))

    @property
    def classes(self) -> int:
        """Classes of own words; the tail is one more."""
        return -(-self.own // self.width)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (rank; ``own`` is the tail) and count (-1 where it isn't among the frequent) of each token hash."""
        if not len(self.frequent):
            return np.zeros(len(h), np.int64), np.full(len(h), -1)
        at = np.searchsorted(self.frequent, h).clip(max=len(self.frequent) - 1)
        here = self.frequent[at] == h
        return np.where(here, np.minimum(self.rank[at], self.own), self.own), np.where(here, self.counts[at], -1)

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes, tail last, and of each own word in its class."""
        c = np.empty(len(self.counts))
        c[self.rank] = self.counts
        c = c[: self.own] + SMOOTH
        first = np.arange(0, self.own, self.width)
        mass = np.append(np.add.reduceat(c, first) if self.own else [], max(0.0, self.total - c.sum()) + SMOOTH)
        return mass / mass.sum(), c / np.repeat(mass[:-1], np.diff(np.append(first, self.own)))


def collected(table: DataFrame) -> Counts:
    """The sums and the most frequent rows of ``table``; a word that occurs as often as a less frequent one comes first by hash."""
    n, v = table.agg(F.sum("c"), F.count("*")).first()
    rows = table.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    h, c = rows["h"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
    o = np.argsort(h)
    return Counts(int(n or 0), int(v), h[o], c[o], o, min(len(h), int(4 * (n or 0) ** 0.5)))


def stream(b: pa.Array, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of a batch: first row, row offsets of the tokens, and token hashes with each row's end token."""
    for w in pieces(b, most):
        h = signed(w.hashes(lower=True))
        yield w.first, w.off + np.arange(len(w.off)), np.insert(h, w.off[1:], END)


def contexts(c: np.ndarray, off: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the last and the second last token before each token; ``begin`` stands before a text's begin."""
    one, two = np.empty_like(c), np.empty_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    one[off[:-1]] = begin
    two[off[:-1]] = begin
    second = off[:-1] + 1
    two[second[second < off[1:]]] = begin
    return one, two


class Model:
    """Parameters: vectors of tokens as contexts, the two matrices, and vectors with biases of classes and of own words."""

    def __init__(self, counts: Counts, seed: int = 3):
        rng, d = np.random.Generator(np.random.PCG64(seed)), DIMENSIONS
        self.counts = counts
        self.class_share, self.word_share = (x.astype(np.float32) for x in counts.unigrams())
        small = lambda n: rng.normal(0, 0.1, (n, d)).astype(np.float32)
        matrix = lambda x: (np.eye(d) * x + rng.normal(0, 0.02, (d, d))).astype(np.float32)
        self.context = small(counts.own + 2)
        self.last, self.second = matrix(0.5), matrix(0.25)
        self.kind = np.concatenate([small(counts.classes + 1), np.log(self.class_share)[:, None]], axis=1)
        self.word = np.concatenate([small(counts.own), np.log(self.word_share)[:, None]], axis=1)
        self.moved = self.turned = None

    def tables(self) -> dict[str, np.ndarray]:
        return {"context": self.context, "last": self.last, "second": self.second, "kind": self.kind, "word": self.word}

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each token (of the tail as a whole) after its two; the model no longer changes."""
        n = self.counts
        if self.moved is None:  # every context through both matrices, once
            # A last column of ones, which meets the biases.
            ones = np.ones((len(self.context), 1), np.float32)
            self.moved = np.hstack([self.context @ self.last, ones]), np.hstack([self.context @ self.second, 0 * ones])
            self.turned = np.ascontiguousarray(self.kind.T), np.ascontiguousarray(self.word.T)
        keys, back = np.unique(_key(one, two, nxt, n.own + 2), return_inverse=True)
        one, two, nxt = _parts(keys, n.own + 2)
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.zeros(0, bool)
        pair = np.cumsum(new) - 1
        hats = self.moved[0].take(one[new], axis=0)
        hats += self.moved[1].take(two[new], axis=0)
        kinds = _kinds(nxt, n)
        total = np.empty(len(hats), np.float32)  # over the classes, of each pair of contexts
        for a in range(0, len(hats), CONTEXTS):
            z = slice(a, a + CONTEXTS)
            total[z] = _log_sums(hats[z] @ self.turned[0])
        hat = hats.take(pair, axis=0)
        out = np.einsum("bd,bd->b", hat, self.kind.take(kinds, axis=0)) - total[pair]
        order = np.argsort(kinds, kind="stable")
        edge = np.searchsorted(kinds[order], np.arange(n.classes + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():  # the tokens of one class at a time
            own = slice(k * n.width, (k + 1) * n.width)
            for a in range(edge[k], edge[k + 1], CONTEXTS):
                at = order[a : min(a + CONTEXTS, edge[k + 1])]
                out[at] += _chosen(hat.take(at, axis=0) @ self.turned[1][:, own], nxt[at] - k * n.width)
        return (out / np.float32(np.log(10)))[back]


def _key(one: np.ndarray, two: np.ndarray, nxt: np.ndarray, base: int) -> np.ndarray:
    """One number, in order, for the three of each token, which are below ``base`` (65,538 at most)."""
    return (one.astype(np.int64) * base + two) * base + nxt


def _parts(key: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, nxt = np.divmod(key, base)
    return *np.divmod(pair, base), nxt


def _kinds(nxt: np.ndarray, n: Counts) -> np.ndarray:
    """The class of each token."""
    kinds = nxt // n.width
    kinds[nxt == n.own] = n.classes
    return kinds


def _chosen(scores: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one column."""
    return scores[np.arange(len(which)), which] - _log_sums(scores)


def _log_sums(scores: np.ndarray) -> np.ndarray:
    """Log of the sum of the powers of each row."""
    with np.errstate(over="ignore"):
        total = np.exp(scores) @ np.ones(scores.shape[1], np.float32)
    if not np.isfinite(total).all() or total.min(initial=1) < 1e-30:  # rare: scores out of the range that can be raised as they are
        most = scores.max(axis=1)
        return most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    return np.log(total)


def _summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, in order, and the sum of the gradients of each."""
    order = np.sort((rows << 32) | np.arange(len(rows)))
    r, order = order >> 32, order & 0xFFFFFFFF
    first = _firsts(r)
    return r[first], np.add.reduceat(grads.take(order, axis=0), first, axis=0)


def _whole(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` as one item each, which are read and written faster by their numbers."""
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]


def _firsts(r: np.ndarray) -> np.ndarray:
    """Where a new value begins in ``r``, which is not empty."""
    return np.flatnonzero(np.r_[True, r[1:] != r[:-1]])


def _noise(scores: np.ndarray, bias: np.ndarray | np.float32) -> np.ndarray:
    """Probability that each is no noise, whose log share times number is ``bias``; in place."""
    np.subtract(bias, scores, out=scores)
    np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


class Trainer:
    """Stochastic gradient steps on a model, with a rate of its own for each parameter, and how often each row was trained."""

    def __init__(self, model: Model, rate: float, seed: int, size: int = BATCH):
        self.model, self.rate, self.size = model, rate, size
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.square = {k: np.full_like(v, 1e-6) for k, v in model.tables().items()}
        self.times = {k: np.zeros(len(v), np.float32) for k, v in model.tables().items()}
        self.noise = np.cumsum(model.class_share, dtype=np.float64)
        self.class_bias = np.log(np.float32(CLASS_NOISE) * model.class_share)

    def step(self, name: str, at: np.ndarray | slice, grads: np.ndarray) -> None:
        square, table = self.square[name], self.model.tables()[name]
        if isinstance(at, slice):
            square[at] += grads * grads
            table[at] -= self.rate * grads / np.sqrt(square[at])
            return
        # ``at`` names each row once.
        now = square.take(at, axis=0)
        now += grads * grads
        _whole(square)[at] = _whole(now)
        np.sqrt(now, out=now)
        np.divide(grads, now, out=now)
        now *= -np.float32(self.rate)
        now += table.take(at, axis=0)
        _whole(table)[at] = _whole(now)

    def batch(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray, weight: np.ndarray) -> None:
        m, n = self.model, self.model.counts
        size, d = len(nxt), DIMENSIONS
        order = np.sort((nxt << 32) | np.arange(size))  # by the next token, so by class too
        nxt, order = order >> 32, order & 0xFFFFFFFF
        one, two, weight = one[order], two[order], weight[order]
        scale = np.float32(1 / weight.sum())
        ra, rb = m.context.take(one, axis=0), m.context.take(two, axis=0)
        flat = np.ones((size, d + 1), np.float32)
        flat[:, :d] = ra @ m.last + rb @ m.second
        heavy = flat * weight[:, None]
        # Classes: the noise is drawn once for the batch.
        kinds = _kinds(nxt, n)
        first = _firsts(kinds)
        there = kinds[first]
        drawn = np.searchsorted(self.noise, self.rng.random(CLASS_NOISE)).clip(max=n.classes)
        own, other = m.kind.take(kinds, axis=0), m.kind[drawn]
        good = _noise(np.einsum("bd,bd->b", flat, own), self.class_bias[kinds]) - 1
        bad = _noise(flat @ other.T, self.class_bias[drawn])
        dhat = good[:, None] * own[:, :d]
        dhat += bad @ other[:, :d]
        steps = [("kind", *_summed(np.concatenate([there, drawn]), np.concatenate([np.add.reduceat(good[:, None] * heavy, first, axis=0), bad.T @ heavy])))]
        # Words in their classes: the noise is drawn once for each class of the batch.
        if most := int(np.searchsorted(nxt, n.own)):
            there = there[there < n.classes]
            edge = np.append(first[: len(there)], most)
            wide = np.minimum(n.width, n.own - there * n.width)
            among = there[:, None] * n.width + (self.rng.random((len(there), WORD_NOISE)) * wide[:, None]).astype(np.int64)
            bias = np.log(WORD_NOISE / wide).astype(np.float32)
            words = nxt[:most]
            own, others = m.word.take(words, axis=0), m.word.take(among, axis=0)
            good = _noise(np.einsum("bd,bd->b", flat[:most], own), np.repeat(bias, np.diff(edge))) - 1
            dhat[:most] += good[:, None] * own[:, :d]
            back = np.empty_like(others)
            for a, z, other, b, out in zip(edge[:-1].tolist(), edge[1:].tolist(), others, bias, back, strict=True):
                bad = _noise(flat[a:z] @ other.T, b)
                dhat[a:z] += bad @ other[:, :d]
                np.matmul(bad.T, heavy[a:z], out=out)
            first = _firsts(words)
            steps.append(("word", *_summed(np.concatenate([words[first], among.ravel()]), np.concatenate([np.add.reduceat(good[:, None] * heavy[:most], first, axis=0), back.reshape(-1, d + 1)]))))
        dhat *= (weight * scale)[:, None]
        (r1, g1), (r2, g2) = _summed(one, dhat), _summed(two, dhat)
        turn = ("last", ra.T @ dhat), ("second", rb.T @ dhat)
        at, g = _summed(np.concatenate([r1, r2]), np.concatenate([g1 @ m.last.T, g2 @ m.second.T]))
        for name, rows, grads in steps:
            self.step(name, rows, grads * scale)
        self.step("context", at, g)
        for name, g in turn:
            self.step(name, slice(None), g)

    def examples(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray) -> None:
        """Trains on all of them, equal ones as one with a weight; heavier ones than ``HEAVY`` are dealt to several steps."""
        base = self.model.counts.own + 2
        keys, times = np.unique(_key(one, two, nxt, base), return_counts=True)
        parts = -(-times // HEAVY)
        order = self.rng.permutation(int(parts.sum()))
        keys, weight = np.repeat(keys, parts)[order], np.repeat((times / parts).astype(np.float32), parts)[order]
        x = *_parts(keys, base), weight
        steps = -(-len(order) // self.size)
        for k in range(steps):
            self.batch(*(v[k * len(order) // steps : (k + 1) * len(order) // steps] for v in x))
        self.count(*x)

    def count(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray, weight: np.ndarray) -> None:
        """Adds the examples to the times that each row was trained."""
        n = self.model.counts
        inside = nxt < n.own
        for name, rows, w in (("context", one, weight), ("context", two, weight), ("kind", _kinds(nxt, n), weight), ("word", nxt[inside], weight[inside])):
            self.times[name] += np.bincount(rows, w, minlength=len(self.times[name])).astype(np.float32)
        for name in ("last", "second"):
            self.times[name] += weight.sum()


def triples(b: pa.Array, counts: Counts) -> Iterator[np.ndarray]:
    """(last, second last, next) of every token of the texts of a batch."""
    for _, off, h in stream(b):
        c, _ = counts.found(h)
        yield np.stack([*contexts(c, off, counts.own + 1), c])


def first_model(learn: DataFrame, counts: Counts) -> Model:
    """The model before the rounds of ``trained``; a corpus of ``FIRST`` tokens at most needs none, as the driver trains on all of it."""
    model = Model(counts)
    if counts.total > FIRST:
        return model
    shared = learn.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in triples(b.column(0), shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=["one", "two", "nxt"])

    rows = learn.select("text").mapInArrow(run, "one long, two long, nxt long").toPandas().sort_values(["one", "two", "nxt"])
    trainer = Trainer(model, RATE, 5)
    x = [rows[c].to_numpy(np.int64) for c in ("one", "two", "nxt")]
    for _ in range(2):
        trainer.examples(*x)
    return model


def trained(learn: DataFrame, model: Model, scratch: Scratch) -> None:
    """Trains ``model`` on every token of ``learn``, each in one of two rounds."""
    early = F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0
    texts, total = learn.select("text"), model.counts.total
    for rows, tokens, size in ((texts.where(early), total // EVERY, BATCH), (texts.where(~early), total, LATER_BATCH)):
        a_round(rows, max(1, tokens // COPY), model, size, scratch)


def a_round(texts: DataFrame, copies: int, model: Model, size: int, scratch: Scratch) -> None:
    """Goes on from ``model`` in each task, and gives it the weighted means of what the tasks have made of its rows."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    parts = min(PARTS, 1 + copies // PARTS)
    schema = "name string, block long, part long, times binary, total binary"

    def chunks(batches: Iterator[pa.RecordBatch], counts: Counts) -> Iterator[np.ndarray]:
        held, n = [], 0
        for b in batches:
            for x in triples(b.column(0), counts):
                held.append(x)
                n += x.shape[1]
                if n >= CHUNK:
                    yield np.concatenate(held, axis=1)
                    held, n = [], 0
        if held:
            yield np.concatenate(held, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        trainer, part = None, 0
        for x in chunks(batches, shared.value.counts):
            if trainer is None:
                part = int(x.sum()) % parts
                trainer = Trainer(copy.deepcopy(shared.value), RATE, int(x.sum()), size)
            trainer.examples(*x)
        if trainer is not None:
            for name, table in trainer.model.tables().items():
                times = trainer.times[name]
                for a in range(0, len(table), ROWS):
                    t = times[a : a + ROWS]
                    if t.any():
                        yield _block(name, a // ROWS, part, t, table[a : a + ROWS] * t[:, None])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for name, block, part, times, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (name, block, part) != now and held:
                    yield _block(*now, *held)
                    held = None
                now, more = (name, block, part), [np.frombuffer(x, np.float32) for x in (times, total)]
                held = more if held is None else [x + y for x, y in zip(held, more, strict=True)]
        if held:
            yield _block(*now, *held)

    made = scratch.keep(texts.coalesce(copies).mapInArrow(run, schema))
    key = ("name", "block", "part")
    some = made.repartition(*key).sortWithinPartitions(*key).mapInArrow(add, schema).withColumn("part", F.lit(0).cast("long"))
    whole = some.repartition(*key).sortWithinPartitions(*key).mapInArrow(add, schema)
    tables = model.tables()
    for r in whole.collect():  # the model's size, whatever the corpus
        t = np.frombuffer(r["times"], np.float32)
        place = slice(r["block"] * ROWS, r["block"] * ROWS + len(t))
        mean = np.frombuffer(r["total"], np.float32).reshape(len(t), -1) / np.maximum(t, 1)[:, None]
        tables[r["name"]][place] = np.where(t[:, None] > 0, mean, tables[r["name"]][place])
    scratch.drop(made)


def _block(name: str, block: int, part: int, times: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    columns = ([name], pa.string()), ([block], pa.int64()), ([part], pa.int64()), ([times.astype(np.float32).tobytes()], pa.binary()), ([total.astype(np.float32).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["name", "block", "part", "times", "total"])


def scored(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "scores")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = docs.where(fold() != 0)
    table = scratch.keep(token_counts(learn))
    counts = collected(table)
    model = first_model(learn, counts)
    if counts.total > FIRST:
        trained(learn, model, scratch)
    denominator = float(np.log10(counts.total + SMOOTH * (counts.distinct + 1)))
    # Mass of the tail: all training tokens outside the model's words, and one unseen word.
    own = int(counts.counts[counts.rank < counts.own].sum()) if len(counts.counts) else 0
    tail = float(np.log10(counts.total - own + SMOOTH * (counts.distinct - counts.own + 1)))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counts = model.counts
        for b in batches:
            ids, keys = b.column(0), b.column(1).to_numpy()
            for first, off, h in stream(b.column(2), TEXTS):
                c, known = counts.found(h)
                one, two = contexts(c, off, counts.own + 1)
                lm = model.log_probabilities(one, two, c).astype(np.float64)
                near = known >= 0
                logs = np.where(near, np.log10(np.maximum(known, 0) + SMOOTH), 0.0)
                sums = lambda x: np.add.reduceat(x, off[:-1])
                rows = len(off) - 1
                key = keys[first : first + rows]
                # A row for the document: what needs no join; its word is null.
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(rows, pa.int64()), ids.slice(first, rows), pa.array(key), pa.array(np.diff(off)), pa.array(sums(near.astype(np.int64))), pa.array(sums(logs)), pa.array(sums(lm + np.where(c == counts.own, logs - tail, 0.0)))],
                    names=NAMES,
                )
                rare = np.flatnonzero(~near)
                row = np.repeat(np.arange(rows), np.diff(off))[rare]
                word, at = h[rare], np.lexsort((h[rare], row))
                new = np.flatnonzero(np.r_[True, (row[at][1:] != row[at][:-1]) | (word[at][1:] != word[at][:-1])]) if len(at) else at
                times = np.diff(np.append(new, len(at)))
                at = at[new]
                zero = np.zeros(len(at))
                yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.nulls(len(at), pa.int64()), pa.array(key[row[at]]), pa.array(times.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names=NAMES)

    # Rows of one id and one text are alike, and have one key.
    rows = scratch.keep(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "h long, doc_id long, key long, tokens long, known long, base double, lm double"))
    ready = rows.where("h IS NULL")
    rare = rows.where("h IS NOT NULL").select("h", "key", "tokens").join(table, "h", "left")
    rare = rare.groupBy("key", "h").agg(F.first("tokens").alias("n"), F.first("c").alias("c"))
    log = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    rare = scratch.keep(rare.groupBy("key").agg(F.sum(F.col("n") * log).alias("log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("found")))
    out = ready.join(rare, "key", "left")
    log, found = (F.coalesce(x, F.lit(0)) for x in ("log", "found"))
    out = out.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + found).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("tokens") * denominator).alias("base_score"),
        (F.col("lm") + log).alias("score"),
    )
    out = scratch.keep(out)
    scratch.drop(table, rows, rare)
    return out


NAMES = ["h", "doc_id", "key", "tokens", "known", "base", "lm"]


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
