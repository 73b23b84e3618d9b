"""Removal of passages that an earlier document has: count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import WORD, Rolling, WordHash, clear, merged, mixed, sliding_min, small_batches, table, texts, written
from latticework.llm.sketch import prefilter

GRAM = 24  #: words of the runs whose least hash stands for a window in the sketch
CHUNK = 1_500_000  #: window rows that are combined before they are shuffled
EMPTY = hashlib.sha256(b"").hexdigest()

_words, _first, _second = WordHash(1), Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)


def window_keys(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For every window of the text: 64 and 32 bits that identify its words, and the least hash of its ``gram``-word runs."""
    words = WORD.findall(text)
    if len(words) < window:
        return None
    items = _words.of(words)
    prefix = _first.prefix(items)
    second = _second.runs(_second.prefix(mixed(items)), window)
    return _first.runs(prefix, window), (second >> np.uint64(32)).astype(np.int32), sliding_min(_first.runs(prefix, gram), window - gram + 1)


def later_windows(docs: DataFrame, window: int, gram: int, log2: int | None = None) -> DataFrame:
    """(doc_id, starts), written: starts of windows that a smaller doc_id has too, as little-endian 32-bit integers, in several rows for a document."""

    def marks(text: bytes) -> np.ndarray:
        keys = window_keys(text, window, gram)
        return np.unique(keys[2]) if keys else np.zeros(0, np.uint64)  # once for each document

    pre = prefilter(docs, marks, 84, log2)
    test = pre.test

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows estimated repeated. Of equal ones met in this chunk only those of the least doc_id go on; the others are settled here."""
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, second, ids, starts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((starts, ids, second, first))
            first, second, ids, starts = first[order], second[order], ids[order], starts[order]
            new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
            least = ids[new][np.cumsum(new) - 1]
            late = ids > least
            settled_ids, settled = ids[late], starts[late]
            by = np.lexsort((settled, settled_ids))
            settled_ids, settled = settled_ids[by], settled[by]
            heads = np.flatnonzero(np.r_[True, settled_ids[1:] != settled_ids[:-1]]) if len(by) else np.array([], np.int64)
            if len(heads):
                yield rows(mixed(settled_ids[heads].view(np.uint64)).view(np.int64), np.zeros(len(heads), np.int32), settled_ids[heads], settled, np.r_[heads, len(settled)], True)
            keep = ~late
            first, second, ids, starts, new = first[keep], second[keep], ids[keep], starts[keep], new[keep]
            heads = np.r_[np.flatnonzero(new), len(starts)]
            for at in range(0, len(heads) - 1, 50_000):
                to = min(at + 50_000, len(heads) - 1)
                h = heads[at : to + 1]
                yield rows(first[h[:-1]].view(np.int64), second[h[:-1]], ids[h[:-1]], starts[h[0] : h[-1]], h - h[0], False)

        def rows(h, h2, ids, starts, heads, settled) -> pa.RecordBatch:
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer((heads * 4).astype("<i4").tobytes()), pa.py_buffer(starts.astype("<u4").tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), pa.array(ids), blob, pa.array(np.full(len(h), settled))], ["h", "h2", "doc_id", "starts", "settled"])

        for b in batches:
            for i, t, own in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                if i is None or not (keys := window_keys(t, window, gram)):
                    continue
                at = np.flatnonzero(test(keys[2], own))
                if len(at):
                    held.append((keys[0][at], keys[1][at], np.full(len(at), i, np.int64), at.astype(np.uint32)))
                    if (n := n + len(at)) > CHUNK:
                        yield from flush()
                        n = 0
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by window and doc_id: all but the least doc_id of a window are later ones."""
        last: tuple | None = None
        for b in batches:
            h, h2, ids, settled = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
            head = np.r_[last is None or (h[0], h2[0]) != last[:2], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
            least = ids[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
            if not head[0]:
                least[: np.argmax(head) if head.any() else len(head)] = last[2]
            last = (h[-1], h2[-1], least[-1])
            keep = pa.array(settled | (ids > least))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(2).filter(keep), b.column(3).filter(keep)], ["doc_id", "starts"])

    sorted_rows = pre.docs.mapInArrow(let_through, "h long, h2 int, doc_id long, starts binary, settled boolean").repartition("h").sortWithinPartitions("h", "h2", "settled", "doc_id")
    out = written(sorted_rows.mapInArrow(settle, "doc_id long, starts binary"), "later-windows")
    pre.close()
    return out


def without_repeats(docs: DataFrame, window: int = 50, gram: int = GRAM, log2: int | None = None) -> DataFrame:
    """Removes words covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    docs: doc_id, text; further columns pass through. Adds n_words, n_removed and kept (the words that stay, joined by one
    space). Windows are judged on the input. A text with no removed word has ``kept`` null if and only if it is null. Null and
    empty texts have no words. Rows with the same doc_id count as one document's (repeated rows are treated alike); rows with null
    doc_id neither lose words nor make others lose them. An empty table gives an empty result.

    Every window is stood for by the least hash of its ``gram``-word runs, so equal windows have equal marks; the sketch counts
    in how many documents each mark occurs and never too low, so no repeated window is lost. Windows that it lets through are
    grouped exactly by 96 bits of their words; equal windows in one chunk of a task become one row before the shuffle.
    ``log2``: cells of the sketch, if not by the input's size.
    """
    small_batches(docs.sparkSession)
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    starts, key = clear(rows, "starts", "key")
    late = later_windows(rows, window, gram, log2).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("starts").alias(starts))
    joined = rows.join(merged(late), F.col("doc_id") == F.col(key), "left")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    schema = joined.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, later in zip(b.column(b.schema.get_field_index("text")), b.column(len(names))):
                raw = t.as_py()
                words = WORD.findall((raw or "").encode())
                n_words.append(len(words))
                if later.as_py():
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.frombuffer(b"".join(later.as_py()), "<u4")
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(None if raw is None else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return joined.select(*names, starts).mapInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller doc_id has go from all ``documents``: (doc_id, n_words, n_removed, kept_sha256)."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM w, unnest(range(1, len(ws) - 48)) AS r(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM late, unnest(range(0, 50)) AS r(k)),
marks AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ats), 0) AS g,
  array_to_string(CASE WHEN ats IS NULL THEN ws ELSE [ws[k] FOR k IN range(1, len(ws) + 1) IF NOT list_contains(ats, k)] END, ' ') AS s
  FROM w LEFT JOIN marks USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM kept
"""
