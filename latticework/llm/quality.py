"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import WORD, WordHash, small_batches, table, texts
from latticework.llm.labelled import fold, sample, squash

WORDS = 1 << 15  #: buckets of hashed words
BINS = 24  #: of each statistic
STATISTICS = 14
#: Share of letters, digits and so on by byte: lower case, upper case, digit, space, line end, full stop or comma, other ASCII, not ASCII.
KIND = np.array([4 if b == 10 else 3 if b in (9, 11, 12, 13, 32) else 2 if 48 <= b < 58 else 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 5 if b in (44, 46) else 7 if b >= 128 else 6 for b in range(256)], np.uint8)

_hashes = WordHash(7)


def document(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights (unit length together) and the statistics of a whole text; a text without words has no buckets."""
    words = WORD.findall(text)
    h = _hashes.of(words)
    n = len(words)
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=8) / max(len(text), 1)
    distinct, counts = np.unique(h, return_counts=True)
    buckets, at = np.unique((distinct % np.uint64(WORDS)).astype(np.int64), return_inverse=True)
    weights = np.log1p(np.bincount(at, counts, minlength=len(buckets)))
    lines = text.count(b"\n") + 1
    statistics = np.array([
        *kinds, np.log1p(len(text)), np.log1p(n / lines), len(distinct) / max(n, 1), len(text) / max(n, 1),
        np.mean(h[1:] == h[:-1]) if n > 1 else 0.0, np.log1p(counts.max(initial=0)) - np.log1p(n),
    ])
    return buckets, weights / max(np.sqrt((weights**2).sum()), 1e-9), statistics


@dataclass
class Machine:
    edges: np.ndarray  #: of the bins, one row for each statistic
    constant: float
    linear: np.ndarray
    factors: np.ndarray

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        buckets, weights, statistics = document(text)
        bins = WORDS + np.arange(STATISTICS) * BINS + np.array([np.searchsorted(e, s) for e, s in zip(self.edges, statistics)])
        return np.concatenate([buckets, bins]), np.concatenate([weights, np.full(STATISTICS, STATISTICS**-0.5)])

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        """Pairwise terms in linear time: half of (square of the sum less sum of the squares), factor by factor."""
        v = self.factors[index] * x[:, None]
        return self.constant + self.linear[index] @ x + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    def score(self, text: bytes) -> float:
        return float(squash(np.array(self.raw(*self.features(text)))))


def train(good: list[str], bad: list[str], prior: float, rank: int = 8, epochs: int = 12, rate: float = 0.02, decay: float = 1e-5, batch: int = 64) -> Machine:
    """Adam on the logistic loss; ``prior`` is the share of good rows among all labelled ones, to which scores are calibrated. Same input, same model."""
    rng = np.random.default_rng(11)
    both = [t.encode() for t in [*good, *bad]]
    size = WORDS + STATISTICS * BINS
    m = Machine(np.zeros((STATISTICS, BINS - 1)), 0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    if not good or not bad:
        m.constant, m.factors = (4.0 if good else -4.0 if bad else 0.0), m.factors * 0
        return m
    y = np.r_[np.ones(len(good)), np.zeros(len(bad))]
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    m.edges = np.quantile(np.array([document(t)[2] for t in both]), np.arange(1, BINS) / BINS, axis=0).T
    rows = [m.features(t) for t in both]
    m.constant = float(np.log(prior / (1 - prior)))
    held = [np.zeros((size, rank + 1)), np.zeros((size, rank + 1))]
    first = [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            index = np.concatenate([rows[k][0] for k in part])
            x = np.concatenate([rows[k][1] for k in part])
            sizes = np.array([len(rows[k][0]) for k in part])
            heads = np.cumsum(sizes) - sizes
            v = m.factors[index] * x[:, None]
            total = np.add.reduceat(v, heads)
            z = m.constant + np.add.reduceat(m.linear[index] * x, heads) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), heads))
            slope = np.repeat((squash(z) - y[part]) * weight[part], sizes) / len(part)
            g = np.column_stack([slope[:, None] * (x[:, None] * np.repeat(total, sizes, axis=0) - v * x[:, None]), slope * x])
            step += 1
            used, back = np.unique(index, return_inverse=True)
            grad = np.zeros((len(used), rank + 1))
            np.add.at(grad, back, g)
            grad += decay * np.column_stack([m.factors[used], m.linear[used]])
            held[0][used] = 0.9 * held[0][used] + 0.1 * grad
            held[1][used] = 0.99 * held[1][used] + 0.01 * grad**2
            move = rate * (held[0][used] / (1 - 0.9**step)) / (np.sqrt(held[1][used] / (1 - 0.99**step)) + 1e-8)
            m.factors[used] -= move[:, :rank]
            m.linear[used] -= move[:, rank]
            g0 = float(((squash(z) - y[part]) * weight[part]).mean())
            first = [0.9 * first[0] + 0.1 * g0, 0.99 * first[1] + 0.01 * g0**2]
            m.constant -= rate * (first[0] / (1 - 0.9**step)) / (np.sqrt(first[1] / (1 - 0.99**step)) + 1e-8)
    return m


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds score (0 to 1, higher: better) to ``docs``, which has a column text and no column _score; all columns pass through.

    Whole texts; null counts as empty; empty texts get the score of their statistics alone. Repeated rows get
    equal scores, and so do texts with the same features (ties). No rows: an empty result.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size
    names = [c for c in docs.columns if c != "score"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores = pa.array([m.score(t) for t in texts(b.column(at))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), scores], [*names, "score"])

    return docs.select(*names).mapInArrow(run, docs.select(*names, F.lit(0.0).alias("score")).schema)


def fitted(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Machine:
    """Trains on up to ``most`` labelled texts of each class; held-out rows are never among them."""
    seen = {r.quality: r.n for r in labels.where(fold() != 0).groupBy("quality").agg(F.count("*").alias("n")).where("quality in (0, 1)").collect()}
    prior = seen.get(1, 0) / max(sum(seen.values()), 1)
    return train(sample(docs, labels, "quality", 1, most), sample(docs, labels, "quality", 0, most), prior)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``: (doc_id, held_out, score, predicted), trained on labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
