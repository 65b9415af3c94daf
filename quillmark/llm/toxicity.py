"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression on sparse word features.

One weight vector is shared by all ordered thresholds: ``P(grade > k) = sigmoid(w.x - theta_k)``.
It is fitted on a bounded, seeded sample of labelled documents; grades above 0 come from the labels
(0: not toxic) and, among toxic documents, from how often they use words that the labels single out.
Every document is then scored whole, where it is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_state

#: Labelled rows that the model is fitted on at most (those of least seeded hash); buckets of hashed words.
TRAIN_ROWS, BUCKETS = 10_000, 1 << 18
GRADES, STEPS, RIDGE, RATE = 4, 150, 2e-4, 0.1
MIN_DOCS, CACHE_WORDS = 3, 400_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


class WordBuckets(dict):
    """A bounded cache from a chunk to its word's bucket: lower case, without punctuation at its ends."""

    def __missing__(self, chunk: str) -> int:
        value = xxhash.xxh3_64_intdigest(chunk.strip(_EDGE).encode()) % BUCKETS
        if len(chunk) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = value
        return value


def features(text: str | None) -> Counter:
    """Occurrences of each bucket in the whole text."""
    found: Counter = Counter()
    buckets = worker_state("word-buckets", WordBuckets)
    for chunk, n in Counter((text or "").lower().split()).items():
        found[buckets[chunk]] += n
    return found


@dataclass
class Ordinal:
    """A fitted model: dense weights by bucket and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold (rows: documents)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def singled_out(rows: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """Buckets that the labels mark as toxic: in MIN_DOCS different toxic documents at least, rare in others.

    The least number does not grow with the sample, so the insults of a small language are learned too.
    Equal rows count once, so copies of a document do not mark all of its words.
    """
    seen, n, known = np.zeros((2, BUCKETS)), [0, 0], set()
    for row, t in zip(rows, toxic, strict=True):
        key = (bool(t), frozenset(row.items()))
        if key not in known:
            known.add(key)
            seen[0 if t else 1, list(row)] += 1
            n[0 if t else 1] += 1
    return (seen[0] >= MIN_DOCS) & (seen[0] / max(1, n[0]) > 10 * (seen[1] + 0.5) / max(1, n[1]))


def severity(rows: list[Counter], toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades from 0/1 labels: toxic documents by equal parts of their number of singled-out words."""
    marked = singled_out(rows, toxic)
    hits = np.array([sum(c for b, c in row.items() if marked[b]) for row in rows])
    if not toxic.any():
        return np.zeros(len(rows), int)
    cuts = np.quantile(hits[toxic], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)


def fit(rows: list[Counter], toxic: np.ndarray, grades: int = GRADES) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood with a ridge; only singled-out buckets get a weight."""
    y = severity(rows, toxic, grades)
    used = np.flatnonzero(singled_out(rows, toxic))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    owner, column, value = [], [], []
    for k, row in enumerate(rows):
        for b, c in row.items():
            if place[b] >= 0:
                owner.append(k)
                column.append(place[b])
                value.append(c)
    owner, column, value = np.array(owner, int), np.array(column, int), np.log1p(np.array(value, float))
    w, theta = np.zeros(len(used)), np.linspace(1, 3, grades - 1)
    if not len(rows) or not toxic.any() or toxic.all() or not len(used):
        return Ordinal(np.zeros(BUCKETS, np.float32), np.full(grades - 1, 30.0))
    target = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    rare = toxic.mean()
    each = np.where(toxic, min(5.0, 0.25 / rare), 1.0)[:, None] / len(rows)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, value * w[column], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -30, 30)))
        slack = (p - target) * each
        gw = np.bincount(column, value * slack.sum(1)[owner], len(used)) + RIDGE * w
        gt = -slack.sum(0)
        for at, (x, g) in enumerate(((w, gw), (theta, gt))):
            m, v = state[2 * at], state[2 * at + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta.sort()
    full = np.zeros(BUCKETS, np.float32)
    full[used] = w
    return Ordinal(full, theta)


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[Counter], np.ndarray]:
    """Features of the sample: at most ``train_rows`` labelled ids of least hash, gathered on the driver."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(train_rows)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["doc_id", "toxic", "b", "n"])

    got = texts.mapInArrow(run, "doc_id long, toxic int, b array<int>, n array<int>").toArrow()
    rows = sorted({r["doc_id"]: r for r in got.to_pylist()}.values(), key=lambda r: r["doc_id"])
    return [Counter(dict(zip(r["b"], r["n"], strict=True))) for r in rows], np.array([r["toxic"] == 1 for r in rows], bool)


def score(docs: DataFrame, model: Ordinal, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, grade, expected_severity, p_toxic, toxic): one row per input row.

    Null or empty text has no features and gets the thresholds' base rate; texts are read whole.
    Null ids and repeated rows are scored like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds))  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        model = Ordinal(weights, thresholds)
        for batch in batches:
            scores = []
            for t in batch.column(1):
                found = features(t.as_py())
                at = np.fromiter(found.keys(), np.int64, len(found))
                scores.append(float(weights[at] @ np.log1p(np.fromiter(found.values(), np.float64, len(found)))))
            above = model.above(np.array(scores))
            chance = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1))
            cols = [chance.argmax(1).astype(np.int32), above.sum(1), above[:, 0], above[:, 0] >= 0.5]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, grade int, expected_severity double, p_toxic double, toxic boolean")


def rate_toxicity(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labels' sample and score all documents.  Without toxic labels nothing is toxic."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    return score(docs, fit(*training_rows(texts, labels, train_rows)))
