"""Line dedup by winnowing: window minima of line hashes as fingerprints, their positions joined, matches extended both ways, later runs deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import Rolling, clear, merged, mixed, small_batches, table, texts, written

LEAST = 24  #: bytes of the shortest run that counts: one line, or several short ones together
_first, _second = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)


def lines_of(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """All lines, and the numbers of those that count: lines with anything but white space."""
    lines = text.split(b"\n")
    return lines, np.array([k for k, x in enumerate(lines) if x.strip()], np.int64)


def spans(sizes: np.ndarray, least: int) -> np.ndarray:
    """Rows (first, last) of the windows: from each line the fewest lines onward that have ``least`` bytes together, and to each line the fewest before it.

    A run of ``least`` bytes or more is the union of the windows inside it: a line from which the run goes on for ``least`` bytes is in
    its window onward; any other has the window back from the run's last line.
    """
    n = len(sizes)
    own = np.arange(n)
    if sizes.min(initial=least) >= least:
        return np.stack([own, own], 1)
    p = np.r_[0, np.cumsum(sizes)]
    end = np.searchsorted(p, p[:-1] + least, side="left") - 1
    start = np.searchsorted(p, p[1:] - least, side="right") - 1
    ahead, back = end < n, start >= 0
    both = np.unique(np.r_[own[ahead] * n + end[ahead], start[back] * n + own[back]])
    return np.stack([both // n, both % n], 1)


def selected(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The line that each window selects: that with its least hash, the last of equal ones."""
    out = at[:, 1].copy()
    for k in np.flatnonzero(at[:, 0] < at[:, 1]).tolist():
        s, e = at[k]
        out[k] = e - int(h[s : e + 1][::-1].argmin())
    return out


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, size): hash and bytes of each counting line, for documents that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends, h, sizes = [], [0], [], []
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                counting = [x for x in t.split(b"\n") if x.strip()] if i is not None else []
                if counting:
                    ids.append(i)
                    h += map(xxhash.xxh64_intdigest, counting)
                    sizes += map(len, counting)
                    ends.append(len(h))
            if ids:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "h", "size"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h array<long>, size array<int>")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    h, size, cuts = b.column(1).flatten().to_numpy().view(np.uint64), b.column(2).flatten().to_numpy().astype(np.int64), b.column(1).offsets.to_numpy()
    for i, s, e in zip(b.column(0).to_pylist(), (cuts - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist()):
        yield i, h[s:e], size[s:e]


def repeated_runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, first, last): windows that occur earlier, in a smaller doc_id or further up, as ranks among the counting lines.

    Every window selects its line of least hash, so equal windows select equal lines: a run that repeats is found though only the selected
    lines, fewer than all where lines are short, are compared. Their positions are joined with the hashes that are selected twice or more; each
    joined position is extended to the windows, before and after it, that select it. Windows are matched by 128 bits, each with its first place, so
    that a line that a third of all documents share is aggregated before the shuffle and never paired.
    """
    marked = written(line_hashes(docs), "line-hashes")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ids, lines = [], [], []
            for i, h, size in _rows(b):
                at = selected(h, spans(size, least))
                if (at[1:] <= at[:-1]).any():
                    at = np.unique(at)
                fps.append(h[at].view(np.int64))
                ids.append(np.full(len(at), i, np.int64))
                lines.append(at.astype(np.int32))
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (fps, ids, lines)], ["fp", "doc_id", "line"])

    positions = marked.mapInArrow(select, "fp long, doc_id long, line int")
    # counted apart from the join, which can then split the positions of a hot line
    often = written(positions.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "line-often")
    joined = positions.join(merged(often), "fp", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("at"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            cuts, lines = b.column(3).offsets.to_numpy(), b.column(3).flatten().to_numpy()
            for k, (i, h, size) in enumerate(_rows(b)):
                hit = np.zeros(len(h), bool)
                hit[lines[cuts[k] - cuts[0] : cuts[k + 1] - cuts[0]]] = True
                both = spans(size, least)
                both = both[hit[selected(h, both)]]
                if not len(both):
                    continue
                s, e = both[:, 0], both[:, 1] + 1
                keys = []
                for r, items in ((_first, mixed(h)), (_second, mixed(h ^ np.uint64(0x94D049BB133111EB)))):
                    p = r.prefix(items)
                    keys.append(mixed((p[e] - p[s]) * r.down[s]).view(np.int64))
                out.append((*keys, np.full(len(s), i, np.int64), s.astype(np.int32), (e - 1).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["w1", "w2", "doc_id", "first", "last"])

    windows = marked.join(merged(joined), "doc_id").select("doc_id", "h", "size", "at").mapInArrow(extend, "w1 long, w2 long, doc_id long, first int, last int")
    windows = written(windows, "line-windows")
    place = F.struct("doc_id", "first")
    earliest = written(windows.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-earliest")
    return windows.join(merged(earliest), ["w1", "w2"]).where(place > F.col("least")).select("doc_id", "first", "last")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Deletes the lines of every run of consecutive lines, of ``least`` bytes or more together, that also occurs earlier: in a smaller doc_id, or further up in the same one.

    docs: doc_id, text; further columns pass through; text is replaced by what stays and n_removed_lines (long) is added. With ``least`` 1 every
    line is a run. Lines end at "\\n" and compare byte by byte; lines of white space alone don't count, neither break a run nor are deleted. Runs are
    judged on the input. Null texts stay null, empty ones empty; texts of any length go whole; rows with the same doc_id must be repeats of one row,
    which lose the same lines; rows with null doc_id stay as they are. An empty table gives an empty result.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    small_batches(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    names = [c for c in docs.columns if c != "n_removed_lines"]
    runs, key = clear(docs, "runs", "key")
    late = repeated_runs(docs.select("doc_id", "text"), least).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("first", "last")).alias(runs))
    joined = docs.join(merged(late), F.col("doc_id") == F.col(key), "left").select(*names, runs)
    at_text = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone = [], []
            for t, found in zip(b.column(at_text), b.column(len(names)).to_pylist()):
                raw, n = t.as_py(), 0
                if raw and found:
                    lines, at = lines_of(raw.encode())
                    drop = {int(k) for r in found for k in at[r["first"] : r["last"] + 1]}
                    n, raw = len(drop), b"\n".join(x for k, x in enumerate(lines) if k not in drop).decode()
                kept.append(raw)
                gone.append(n)
            columns = [b.column(k) for k in range(len(names))]
            columns[at_text] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], [*names, "n_removed_lines"])

    return joined.mapInArrow(cut, joined.select(*names, F.lit(0).cast("long").alias("n_removed_lines")).schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and runs of short lines go from all ``documents``: (doc_id, n_removed_lines, kept_sha256)."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, k, ls[k] AS s, regexp_matches(ls[k], '[^\x20\x09-\x0D]') AS counts FROM raw, unnest(range(1, len(ls) + 1)) AS r(k)),
ranked AS (SELECT doc_id, k, s, strlen(s) AS b, row_number() OVER w AS pos, sum(strlen(s)) OVER w AS upto FROM lines WHERE counts WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
near AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM ranked a JOIN ranked b ON b.doc_id = a.doc_id AND b.pos >= a.pos AND b.pos < a.pos + 24 WHERE b.upto - a.upto + a.b >= 24),
spans AS (SELECT doc_id, s, min(e) AS e FROM near GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM near GROUP BY doc_id, e),
wins AS (SELECT x.doc_id, x.s, x.e, string_agg(r.s, chr(10) ORDER BY r.pos) AS t FROM spans x JOIN ranked r ON r.doc_id = x.doc_id AND r.pos BETWEEN x.s AND x.e GROUP BY 1, 2, 3),
late AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS nth FROM wins) WHERE nth > 1),
gone AS (SELECT DISTINCT r.doc_id, r.k FROM late x JOIN ranked r ON r.doc_id = x.doc_id AND r.pos BETWEEN x.s AND x.e)
SELECT l.doc_id, count(g.k) AS n_removed_lines, sha256(coalesce(string_agg(l.s, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id
"""
