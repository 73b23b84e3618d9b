"""Toxicity by compression distance: what a zstandard dictionary of toxic text saves beside one of ordinary text, window by window."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import small_batches, table
from latticework.llm.labelled import fold, logistic, sample, squash

TOKEN = re.compile(r"\w+")
THRESHOLDS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)
#: A match finder that misses nothing in dictionaries of this size; with a faster one, distances depend on hash collisions.
SEARCH = {"window_log": 19, "hash_log": 18, "chain_log": 18, "search_log": 6, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2}
MOST = 400_000  #: windows whose distance a Python worker remembers


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: np.ndarray


#: Stands on both sides of a window and at the end of both dictionaries: its cost is small and always the same, and no window
#: is so short that zstandard would store it as it is.
CARRIER = b"<0123456789=ABCDEFGHIJKLMNOPQRST>"


class Distances(dict):
    """window -> share of its bytes that the ordinary dictionary with the toxic one beside it saves over the ordinary one alone; up to 2 bytes are chance."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        search = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False)

        def new(d: bytes):
            content = zstandard.ZstdCompressionDict(d + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=search)
            return zstandard.ZstdCompressor(dict_data=content, compression_params=search).compress

        self.both, self.ordinary = new(ordinary + toxic), new(ordinary)

    def __missing__(self, window: str) -> float:
        if len(self) >= MOST:
            self.clear()
        raw = b"%s %s %s" % (CARRIER[:16], window.encode(), CARRIER[16:])
        saved = len(self.ordinary(raw)) - len(self.both(raw))
        out = self[window] = saved / (len(raw) - len(CARRIER)) if saved > 2 else 0.0
        return out

    def of(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def features(d: np.ndarray, threshold: float) -> list[float]:
    """Windows over the threshold (count and share), whether there is one, and the largest distance."""
    n = int((d >= threshold).sum())
    return [np.log1p(n), np.sqrt(n / max(len(d), 1)), float(n > 0), float(d.max(initial=0))]


def ordinary_dictionary(texts: list[str], size: int, segment: int = 48, mer: int = 8) -> bytes:
    lines = [f" {' '.join(TOKEN.findall(x.lower()))} ".encode() for t in texts for x in t.split("\n") if x]
    try:
        return zstandard.train_dictionary(size, lines, k=segment, d=mer).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text is the dictionary
        return b"".join(lines)[-size:]


def toxic_dictionary(texts: list[str], against: Counter, n_against: int, size: int, least: int = 2, rare: float = 0.05) -> bytes:
    """Content by cover: of toxic texts' windows those that most texts share, ``least`` at least, and that ordinary texts have at a rate of ``rare`` times theirs
    at most; the most frequent stand last, where they are cheapest to refer to. zstandard's own trainer weighs segments by plain frequency and
    so fills a dictionary with ordinary language: on 300 toxic texts it kept few toxic windows."""
    counts = Counter(w for t in texts for w in set(TOKEN.findall(t.lower())))
    ratio = len(texts) / max(n_against, 1)
    chosen = sorted((w for w, n in counts.items() if n >= least and against[w] * ratio <= rare * n), key=lambda w: (counts[w], w))
    return f" {' '.join(chosen)} ".encode()[-size:]


def train(toxic: list[str], ordinary: list[str], sizes: tuple[int, ...] = (1 << 10, 2 << 10, 4 << 10, 16 << 10), ordinary_size: int = 192 << 10) -> Model:
    """Two dictionaries, the least distance that counts as a hit, and the logistic weights of hits.

    A third of the texts of either class is kept out of the dictionaries and serves to calibrate: the size of the toxic dictionary and the
    threshold are those with which the calibrated score separates those texts best. The toxic dictionary is then built anew from all
    texts, at that size. With no text of a class the score is constant.
    """
    if not toxic or not ordinary:
        return Model(b"", b"", 1, np.array([0.0, 0.0, 0.0, 0.0, -4.0 if ordinary else 4.0 if toxic else 0.0]))
    cut = lambda texts: ([t for k, t in enumerate(texts) if k % 3] or texts, texts[::3])
    (fit_toxic, held_toxic), (fit_ordinary, held_ordinary) = cut(toxic), cut(ordinary)
    common = ordinary_dictionary(fit_ordinary, ordinary_size)
    seen = Counter(w for t in fit_ordinary for w in set(TOKEN.findall(t.lower())))
    held = [TOKEN.findall(t.lower()) for t in [*held_toxic, *held_ordinary]]
    y = np.r_[np.ones(len(held_toxic)), np.zeros(len(held_ordinary))]
    best = None
    for size in sizes:
        for least in (2, 3):
            d = Distances(toxic_dictionary(fit_toxic, seen, len(fit_ordinary), size, least), common)
            apart = [np.fromiter(map(d.__getitem__, words), np.float64, len(words)) for words in held]
            for threshold in THRESHOLDS:
                x = np.array([features(v, threshold) for v in apart])
                w = logistic(x, y)
                p = squash(x @ w[:-1] + w[-1])
                loss = -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-12))
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, size, least, threshold, w)
    _, size, least, threshold, weights = best
    seen.update(w for t in ordinary[::3] if len(ordinary) > 2 for w in set(TOKEN.findall(t.lower())))
    return Model(toxic_dictionary(toxic, seen, len(ordinary), size, least), common, threshold, weights)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), score 0 to 1 (higher: toxic likelier), one row for each row of ``docs``(doc_id, text); further columns, whatever their names, are left out.

    Whole texts, however long: every word is a window. Null, empty and wordless texts get the score of a text without hits. Repeated rows get
    equal scores, and so do texts with the same hits (ties). No rows: an empty result.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        d = Distances(m.toxic, m.ordinary) if m.toxic else None
        for b in batches:
            x = np.array([features(d.of(t or "") if d is not None else np.zeros(0), m.threshold) for t in b.column(1).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(squash(x @ m.weights[:-1] + m.weights[-1]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def fitted(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """Trains on up to ``most`` labelled texts of each class; held-out rows are never among them."""
    return train(sample(docs, labels, "toxic", 1, most), sample(docs, labels, "toxic", 0, most))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``: (doc_id, held_out, score, predicted), trained on labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
