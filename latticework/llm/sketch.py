"""Count-min prefilter: sketches of partitions, merged block by block, tell which marks may occur twice; sized by the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import merged, mixed, texts

DEPTH = 2  #: rows of the sketch
LEAST_LOG2, MOST_LOG2 = 14, 28  #: cells of a row that is merged to one bit a cell and broadcast: 64 MB for both rows at most
WIDE_LOG2 = 48  #: cells of the one row that stays in the cluster where the input needs more than MOST_LOG2
ROOM = 8  #: cells for each mark
BLOCK_LOG2 = 20  #: cells that are merged and sent together, at most
CHUNK = 1_500_000  #: marks that are combined before they are shuffled

Marks = Callable[[bytes], np.ndarray]
Test = Callable[[np.ndarray, "list[int] | None"], np.ndarray]


def cells(marks: np.ndarray, row: int, log2: int) -> np.ndarray:
    return (mixed(marks + np.uint64(0x5851F42D4C957F2D * row & (1 << 64) - 1)) >> np.uint64(64 - log2)).astype(np.int64)


def merged_sketch(docs: DataFrame, marks_of: Marks, log2: int, chunk: int = CHUNK) -> list[np.ndarray]:
    """Bit maps, one for each row of the sketch: is the cell's count, over all documents, 2 or more?

    Each partition counts the marks of its texts; counts saturate at 2, are sent as sorted cell numbers by block and
    added block by block. A count never falls below the true one.
    """
    width = min(BLOCK_LOG2, log2)
    blocks = 1 << log2 - width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in range(DEPTH):
                if not held[row]:
                    continue
                at, many = np.unique(np.concatenate(held[row]), return_counts=True)
                at = at << 1 | (many > 1)  # the lowest bit: twice or more here
                cuts = np.searchsorted(at, np.arange(1, blocks) << width + 1)
                parts = [(k, p) for k, p in enumerate(np.split(at, cuts)) if len(p)]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row * blocks + k for k, _ in parts], pa.int32()), pa.array([(p & (2 << width) - 1).astype("<u4").tobytes() for _, p in parts], pa.binary())], ["block", "cells"]
                    )
                held[row].clear()

        for b in batches:
            for t in texts(b.column(0)):
                marks = marks_of(t)
                if len(marks):
                    n += len(marks)
                    for row in range(DEPTH):
                        held[row].append(cells(marks, row, log2))
            if n > chunk:
                yield from flush()
                n = 0
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: np.ndarray | None = None
        now = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1)):
                if block != now:
                    if counts is not None:
                        yield done()
                    now, counts = block, np.zeros(1 << width, np.uint8)
                at = np.frombuffer(part.as_py(), "<u4")
                counts[at >> 1] = np.minimum(counts[at >> 1] + 1 + (at & 1), 2)
        if counts is not None:
            yield done()

    parts = docs.select("text").mapInArrow(count, "block int, cells binary").repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(add, "block int, bits binary")
    bits = [np.zeros(1 << log2 - 3, np.uint8) for _ in range(DEPTH)]
    for r in parts.toLocalIterator():  # of bounded size: DEPTH * 2**log2 bits
        at = r.block % blocks << width - 3
        bits[r.block // blocks][at : at + (1 << width - 3)] = np.frombuffer(r.bits, np.uint8)
    return bits


def repeated_cells(docs: DataFrame, marks_of: Marks) -> DataFrame:
    """(doc_id, own): each document's cells, of one wide row of the sketch, that have a count of 2 or more. Nothing of it leaves the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *np.unique(cells(marks_of(t), 0, WIDE_LOG2), return_counts=True)) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))) if i is not None]
            if found:
                ids, at, n = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in at])), pa.array(np.concatenate(n))], ["cell", "doc_id", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "cell long, doc_id long, n long")
    often = rows.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell")
    return rows.join(merged(often), "cell", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("cell")).alias("own"))


def id_cells(ids: np.ndarray, log2: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)


def id_bits(ids: DataFrame, log2: int) -> np.ndarray:
    """2**``log2`` bits: those of all ``ids(doc_id)`` are set, others by chance. Made block by block; only the bits reach the driver."""
    width = min(BLOCK_LOG2, log2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = id_cells(b.column(0).to_numpy(), log2)
            yield pa.RecordBatch.from_arrays([pa.array((at >> width).astype(np.int32)), pa.array((at & (1 << width) - 1).astype(np.int32))], ["block", "cell"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        held = np.zeros(1 << width, bool)
        held[t.column("cell").to_numpy()] = True
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    bits = np.zeros(1 << log2 - 3, np.uint8)
    for r in ids.select("doc_id").mapInArrow(place, "block int, cell int").distinct().groupBy("block").applyInArrow(merge, "block int, bits binary").toLocalIterator():
        at = r.block << width - 3
        bits[at : at + (1 << width - 3)] = np.frombuffer(r.bits, np.uint8)
    return bits


def of_ids(docs: DataFrame, ids: DataFrame, log2: int) -> tuple[DataFrame, Broadcast]:
    """Rows (doc_id, text) whose doc_id is among ``ids``, and a few others whose bit is set by chance, without a shuffle of texts; what to release once they are written."""
    held = docs.sparkSession.sparkContext.broadcast(id_bits(ids, log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = id_cells(b.column(0).to_numpy(), log2)
            yield b.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string"), held


@dataclass
class Prefilter:
    """What a second pass needs: ``docs`` (doc_id, text, own), a test of marks to be called in tasks, and what to release afterwards."""

    docs: DataFrame
    test: Test
    held: Broadcast | None

    def close(self) -> None:
        """Releases the broadcast sketch; results that use it must have been written."""
        if self.held is not None:
            self.held.destroy()


def prefilter(docs: DataFrame, marks_of: Marks, spacing: int, log2: int | None = None, wide: bool = True, chunk: int = CHUNK, most_log2: int = MOST_LOG2) -> Prefilter:
    """The test says for which marks of a text the estimated count is 2 or more; all that truly occur twice are among them.

    ``spacing``: bytes of text for each mark, about. The sketch gets ``ROOM`` cells a mark, from a sum of text lengths; up to
    2**MOST_LOG2 cells a row it is merged to bit maps and broadcast. Beyond that, cells are counted by a shuffle of one number a mark and
    each document takes its own repeated ones along, so that the prefilter passes few at any size. Without ``wide`` the bit maps stop growing
    at 2**``most_log2`` cells and pass more: for marks so dense that shuffling them costs what the second pass would. ``chunk``: marks that a task combines at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if log2 is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        log2 = max(LEAST_LOG2, int(ROOM * size / spacing).bit_length())
        if not wide:
            log2 = min(log2, most_log2)
    if log2 > MOST_LOG2:

        def test(marks: np.ndarray, own: list[int] | None) -> np.ndarray:
            return np.isin(cells(marks, 0, WIDE_LOG2), np.array(own or (), np.int64))

        return Prefilter(docs.join(merged(repeated_cells(docs, marks_of)), "doc_id", "left").select("doc_id", "text", "own"), test, None)
    held = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, marks_of, log2, chunk))

    def test(marks: np.ndarray, own: list[int] | None) -> np.ndarray:
        out = np.ones(len(marks), bool)
        for row, bits in enumerate(held.value):
            at = cells(marks, row, log2)
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    return Prefilter(docs.withColumn("own", F.lit(None).cast("array<long>")), test, held)
