"""Quality classifier by compression: how much better a text compresses after good texts than after bad ones.

Two zstandard dictionaries are built from labelled good and bad texts. A text is cut at blanks of bytes into blocks of
``BLOCK`` bytes (so that the dictionary, not the text's own past, does the work in long texts too), every block is
compressed with either dictionary, and the difference of the two sums over the text's own bytes is the raw score. It
alone is turned into a probability, by a logistic curve that is fitted on labelled texts which made no dictionary.

Fitting reads at most ``SAMPLE`` labelled rows of each class for the dictionaries and as many for the curve: those with
the smallest ``xxhash64(doc_id)``, so the choice doesn't depend on partitions. Scoring is one narrow pass over whole
texts; a task holds the dictionaries (under 0.3 MB) and one batch.

Special input: a null or empty text scores 0; a null ``doc_id`` is scored and not held out; labels that are null, or
whose document is missing, teach nothing; a label repeated for a document counts once, with the largest value; without
labels of both classes every text scores by the share of good labels (0.5 if there are none); empty tables give empty
results; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that make the dictionaries, and as many that make the curve.
SAMPLE = 800
DICTIONARY, BLOCK, LEVEL = 112 * 1024, 512, 3
#: Differences are a few hundredths; the fit's small ridge is meant for numbers about 1.
SCALE = 10
THRESHOLD = 0.3
FOLDS = 5


def fold(doc_id: str = "doc_id", n: int = FOLDS):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """Bytes to compress after: a trained dictionary, or the texts themselves where there are too few to train one."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Pair:
    """Compressors with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.of = []
        for raw in (good, bad):
            made = zstandard.ZstdCompressionDict(raw)
            made.precompute_compress(level=LEVEL)
            self.of.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """Bytes that the text takes more after the bad dictionary than after the good one, for each of its own."""
        cut = blocks(text or "")
        good, bad = (sum([len(c.compress(b)) for b in cut]) for c in self.of)
        return (bad - good) / max(1, sum(map(len, cut)))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of 1 and the difference
    constant: float | None = None  # the score of all texts where nothing could be learnt

    def score(self, pair: Pair | None, text: str | None) -> float:
        if not text:
            return 0.0
        if self.constant is not None:
            return self.constant
        z = self.weights[0] + self.weights[1] * SCALE * pair.difference(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(good: list[str], bad: list[str], more_good: list[str], more_bad: list[str], share_good: float) -> Model:
    """Dictionaries from the first two lists, the curve from the others, weighted to the share of good labels."""
    if not (good and bad and more_good and more_bad):
        return Model(b"", b"", (), share_good)
    made = dictionary(good), dictionary(bad)
    pair = Pair(*made)
    x = np.array([(1.0, SCALE * pair.difference(t)) for t in [*more_good, *more_bad]])
    y = np.r_[np.ones(len(more_good)), np.zeros(len(more_bad))]
    w = logistic(x, y)
    # The sample has the classes in its own proportion; the intercept goes back to that of the labels.
    share = min(max(share_good, 1e-3), 1 - 1e-3)
    w[0] += math.log(share / (1 - share)) - math.log(len(more_good) / len(more_bad))
    return Model(*made, tuple(w))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows whose fold is not 0."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold() != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    ids: dict[int, tuple[int, int]] = {}  # at most 4 * SAMPLE
    for q in (0, 1):
        rows = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE).collect()
        for k, r in enumerate(rows):
            ids[r["doc_id"]] = (q, k % 2)
    texts: dict[tuple[int, int], list[str]] = {(q, k): [] for q in (0, 1) for k in (0, 1)}
    if ids:
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = found.where(F.col("doc_id").isin(list(ids)) & (F.length("text") > 0)).groupBy("doc_id").agg(F.min("text").alias("text"))
        for r in sorted(found.collect(), key=lambda r: r["doc_id"]):
            texts[ids[r["doc_id"]]].append(r["text"])
    n = sum(count.values())
    return train(texts[1, 0], texts[0, 0], texts[1, 1], texts[0, 1], count.get(1, 0) / n if n else 0.5)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = None if m.constant is not None else Pair(m.good, m.bad)
        for b in batches:
            s = np.array([m.score(pair, t) for t in b.column(2).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return scored(docs, fit(docs, labels))
