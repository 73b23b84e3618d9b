"""Removal of byte strings that occur more than once: shards of segments with equal anchors, each suffix-sorted by induction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import Rolling, clear, mixed, sliding_min, small_batches, table, texts, written
from latticework.llm.induced_sorting import suffix_order
from latticework.llm.sketch import Prefilter, prefilter

GRAM = 32  #: bytes of the strings whose least hash anchors a window
SHARD = 2 << 20  #: bytes of distinct segments that are sorted together, if one anchor has no more
HELD = 32 << 20  #: bytes of segments that a task gathers before equal ones are sent as one row
CROWD_CELLS = 1 << 22  #: in which segments are counted by anchor, to find crowded ones
CROWD = 512  #: segments of a cell, and 8 times the mean, from which its anchors are parted further
_bytes, _second = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)
_spread = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashes(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the text's short strings, the least of each window, and how many a window has."""
    gram = min(GRAM, window)
    if len(text) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), window - gram + 1
    h = _bytes.runs(_bytes.prefix(_spread[np.frombuffer(text, np.uint8)]), gram)
    return h, sliding_min(h, window - gram + 1), window - gram + 1


def anchor_places(text: bytes, window: int) -> np.ndarray:
    """The anchor of every place that is least in some window: two equal windows, in one stretch even, have two such places."""
    h, least, width = hashes(text, window)
    if not len(least):
        return least
    edge = np.zeros(width - 1, np.uint64)
    return h[h == ~sliding_min(~np.concatenate([edge, least, edge]), width)]


def repeated_starts(segments: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each distinct segment, the starts of windows that also start elsewhere, in it or another one, or in a copy of it."""
    many = [np.arange(len(s) - window + 1) if n > 1 else None for s, n in zip(segments, counts)]
    if len(segments) == 1 and many[0] is not None:
        return [many[0]]
    text = np.frombuffer(b"\xff".join(segments), np.uint8)  # no byte of UTF-8
    sizes = np.array([len(s) for s in segments])
    heads = np.cumsum(sizes + 1) - sizes - 1
    is_start = np.zeros(len(text) + 1, np.int32)
    is_start[heads] += 1
    is_start[heads + sizes - window + 1] -= 1
    is_start = np.cumsum(is_start[:-1]) > 0
    order = suffix_order(text, window)
    order = order[is_start[order]]
    # neighbours in order: is their common prefix a whole window?
    keys = [r.runs(r.prefix(_spread[text]), window) for r in (_bytes, _second)]
    close = (keys[0][order[1:]] == keys[0][order[:-1]]) & (keys[1][order[1:]] == keys[1][order[:-1]])
    again = np.zeros(len(text), bool)
    again[order[1:][close]] = True
    again[order[:-1][close]] = True
    return [m if m is not None else np.flatnonzero(again[h : h + n - window + 1]) for m, h, n in zip(many, heads, sizes)]


def ranges(starts: np.ndarray) -> np.ndarray:
    """Rows (first, count) of consecutive numbers."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first = np.r_[starts[0], starts[cut]]
    last = np.r_[starts[cut - 1], starts[-1]]
    return np.stack([first, last - first + 1], 1)


def parted(h: np.ndarray, anchor: np.uint64, starts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first start) of the parts of a crowded anchor's stretch: within it, windows also agree in their least hash by another order. ``h``: hashes of the stretch's short strings."""
    least = sliding_min(mixed(h[: starts + width - 1] ^ np.uint64(0x94D049BB133111EB)), width)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return mixed(least[first] + anchor), first


def segments(pre: Prefilter, window: int, crowded=None) -> DataFrame:
    """Segments whose anchor is estimated to occur twice: all bytes of the stretch's windows. Equal ones of a chunk become one row.

    With ``crowded`` (anchors' cells, sorted): (anchor, segment, places), stretches of those anchors in parts. Without: (anchor) of each row.
    """
    count_only, test = crowded is None, pre.test

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            for at in range(0, len(items), 2000):
                part = items[at : at + 2000]
                columns = [pa.array([k[0] for k, _ in part], pa.int64())]
                if not count_only:
                    columns += [pa.array([k[1] for k, _ in part], pa.binary()), pa.array([np.array(v, "<i8").tobytes() for _, v in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "segment", "places"][: len(columns)])

        for b in batches:
            for i, t, own in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                if i is None:
                    continue
                h, least, width = hashes(t, window)
                if not len(least):
                    continue
                first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                anchor = least[first]
                stops = np.r_[first[1:], len(least)]
                twice = test(anchor, own)
                full = np.zeros(len(first), bool) if count_only else np.isin(anchor & np.uint64(CROWD_CELLS - 1), crowded.value)
                for k in np.flatnonzero(twice):
                    if full[k]:
                        keys, heads = parted(h[first[k] :], anchor[k], int(stops[k] - first[k]), width)
                        heads = heads + first[k]
                    else:
                        keys, heads = anchor[k : k + 1], first[k : k + 1]
                    for key, head, stop in zip(keys.view(np.int64).tolist(), heads.tolist(), [*heads[1:].tolist(), int(stops[k])]):
                        s = t[head : stop + window - 1]
                        held.setdefault((key, s), []).append((i, head))
                        size += len(s)
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    return pre.docs.mapInArrow(cut, "anchor long" if count_only else "anchor long, segment binary, places binary")


def crowded_cells(rows: DataFrame) -> np.ndarray:
    """Sorted cells of anchors with far more segments than others: an eighth of the cells at most, so of bounded size."""
    cells = rows.groupBy(F.col("anchor").bitwiseAND(F.lit(CROWD_CELLS - 1).cast("long")).alias("cell")).agg(F.count("*").alias("n"))
    cells = written(cells.where(F.col("n") >= CROWD), "crowded-cells")
    mean = (cells.agg(F.sum("n")).first()[0] or 0) / CROWD_CELLS
    return np.sort(np.fromiter((r.cell for r in cells.where(F.col("n") >= 8 * mean).toLocalIterator()), np.uint64))


def repeats(docs: DataFrame, window: int, log2: int | None = None) -> DataFrame:
    """(doc_id, found), written: starts of repeated windows as (first, count) pairs of little-endian 32-bit integers, several rows for a document."""
    sc = docs.sparkSession.sparkContext
    pre = prefilter(docs, lambda t: anchor_places(t, window), 184, log2)
    crowded = sc.broadcast(crowded_cells(segments(pre, window)))  # of bounded size

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor. Anchors are gathered to a shard and sorted together; equal segments count as one."""
        shard: dict[bytes, list[bytes]] = {}
        size, last = 0, None

        def settle() -> Iterator[pa.RecordBatch]:
            segments = list(shard)
            places = [np.frombuffer(b"".join(v), "<i8").reshape(-1, 2) for v in shard.values()]
            shard.clear()
            ids, found = [], []
            for starts, at in zip(repeated_starts(segments, [len(p) for p in places], window), places):
                r = ranges(starts)
                if len(r):
                    for i, s in at.tolist():
                        ids.append(i)
                        found.append((r + [s, 0]).astype("<u4").tobytes())
            for at in range(0, len(ids), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000], pa.int64()), pa.array(found[at : at + 10_000], pa.binary())], ["doc_id", "found"])

        for b in batches:
            for anchor, segment, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if size > SHARD and anchor != last:
                    yield from settle()
                    size = 0
                last = anchor
                if segment in shard:
                    shard[segment].append(at)
                else:
                    shard[segment] = [at]
                    size += len(segment)
        if shard:
            yield from settle()

    rows = segments(pre, window, crowded)
    out = written(rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "doc_id long, found binary"), "suffix-found")
    pre.close()
    crowded.destroy()
    return out


def without_repeats(docs: DataFrame, window: int = 400, log2: int | None = None) -> DataFrame:
    """Removes every byte covered by a ``window``-byte string that also starts anywhere else, in the same or another document.

    docs: doc_id, text; further columns pass through. Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the bytes
    that stay). Strings are judged on the input, may overlap and never cross documents. Null texts count as empty; shorter texts stay whole.
    Repeated rows with one doc_id are copies of each other, so all that is long enough goes; rows of different texts must not share a doc_id (an
    error where they differ in length). Rows with null doc_id stay whole. An empty table gives an empty result.

    Equal windows have the same least 32-byte hash, their anchor. Stretches of windows with an anchor that a count-min sketch estimates
    to occur twice go, as one segment of bytes, to the shard of that anchor, where their suffixes are sorted by induction.
    Anchors with far more segments than others are parted by a second least hash, which equal windows share as well.
    ``log2``: cells of the sketch, if not by the input's size.
    """
    small_batches(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    marks, key = clear(docs, "found", "key")
    found = repeats(docs, window, log2).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("found").alias(marks))
    joined = docs.join(found, F.col("doc_id") == F.col(key), "left").select(*names, marks)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, marks in zip(texts(b.column(names.index("text"))), b.column(len(names)).to_pylist()):
                if not marks:
                    out.append((len(t), 0, 0, t))
                    continue
                r = np.frombuffer(b"".join(marks), "<u4").reshape(-1, 2).astype(np.int64)
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, r[:, 0], 1)
                np.add.at(edge, r[:, 0] + r[:, 1] + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            added = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), *added], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    zero = F.lit(0).cast("long")
    return joined.mapInArrow(drop, joined.select(*names, zero.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.lit(b"").alias("kept")).schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 400-byte strings that occur again go from all ``documents``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, 400 * k AS base, substr(x, 800 * k + 1, 1598) AS y FROM b, unnest(range(0, (strlen(x) + 799) // 800)) AS r(k)),
win AS (SELECT doc_id, base + j AS i, md5(substr(y, 2 * j + 1, 800)) AS h FROM parts, unnest(range(0, 400)) AS r(j) WHERE 2 * j + 800 <= strlen(y)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e) AS e FROM (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, 0, 0 FROM b)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (coalesce(e, strlen(x) // 2) - s)), '' ORDER BY s) AS y FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - s) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
