"""Byte-level BPE with DuckDB: recursive contraction of token-position rows, ordered aggregation for decoding."""

from __future__ import annotations

import base64
import os
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import small_batches, table

#: Fixed value: the characters of Unicode's White_Space property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space inside a run of white space, or at its end where the text ends: there a cut before each space changes the matches.
UNSAFE = re.compile("\\s (?!\\S)|[\\x1c-\\x1f]")
MOST_CHUNKS, MOST_WORDS = 500_000, 600_000  #: remembered in each Python worker
MOST_TOKENS = 1_000_000  #: decoded at once
LONGEST = 64  #: bytes of a word that is contracted as it is

#: One turn contracts, in each word that has one, the leftmost pair of least rank. Rows know the position and token that follow.
SHORT = """
WITH RECURSIVE step(word, pos, token, after, next, turn) AS (
  SELECT word, pos, token, after, next, 0 FROM symbols
  UNION ALL
  (WITH ranked AS MATERIALIZED (SELECT s.*, m.merged FROM step s LEFT JOIN merges m ON m.l = s.token AND m.r = s.next),
   best AS (
     SELECT word, min(merged * 65536::BIGINT + pos) AS k, arg_min(after, merged * 65536::BIGINT + pos) AS eaten
     FROM ranked WHERE merged IS NOT NULL GROUP BY word),
   hit AS MATERIALIZED (
     SELECT b.word, (b.k % 65536)::INT AS pos, (b.k // 65536)::INT AS merged, b.eaten, r.after, r.next
     FROM best b JOIN ranked r ON r.word = b.word AND r.pos = b.eaten)
   SELECT r.word, r.pos, CASE WHEN r.pos = h.pos THEN h.merged ELSE r.token END, CASE WHEN r.pos = h.pos THEN h.after ELSE r.after END,
     CASE WHEN r.pos = h.pos THEN h.next WHEN r.after = h.pos THEN h.merged ELSE r.next END, r.turn + 1
   FROM ranked r JOIN hit h ON h.word = r.word WHERE r.pos <> h.eaten)
)
SELECT word, token FROM (SELECT word, pos, token, turn, max(turn) OVER (PARTITION BY word) AS last FROM step) WHERE turn = last ORDER BY word, pos
"""
#: For long words: one turn contracts the pairs of least rank from left to right, every second one of a row of overlapping pairs, up to the first whose new
#: token makes a pair of lower rank with a neighbour ("wakes"), which then comes first: the order of merges stays that of one at a time. TURNS bounds the rows held.
TURNS = 48
LONG = f"""
WITH RECURSIVE step(word, pos, token, turn) AS (
  SELECT word, pos, token, 0 FROM symbols
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, token, turn, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next FROM step WHERE turn < {TURNS}),
   ranked AS MATERIALIZED (SELECT p.*, m.merged FROM pairs p LEFT JOIN merges m ON m.l = p.token AND m.r = p.next),
   best AS (SELECT word, min(merged) AS merged FROM ranked WHERE merged IS NOT NULL GROUP BY word),
   marked AS (
     SELECT r.word, r.pos, r.token, r.turn, b.merged, coalesce(r.merged = b.merged, false) AS hit FROM ranked r JOIN best b ON b.word = r.word),
   rows AS (
     SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS island,
       lag(token) OVER w AS before, lead(token, 2) OVER w AS after FROM marked WINDOW w AS (PARTITION BY word ORDER BY pos)),
   chosen AS (SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, island ORDER BY pos) % 2 = 1 AS taken FROM rows),
   sided AS MATERIALIZED (SELECT *, CASE WHEN lag(taken, 2) OVER (PARTITION BY word ORDER BY pos) THEN merged ELSE before END AS left_token FROM chosen),
   wakes AS (
     SELECT c.word, min(c.pos) AS pos FROM sided c LEFT JOIN merges p ON p.l = c.left_token AND p.r = c.merged LEFT JOIN merges q ON q.l = c.merged AND q.r = c.after
     WHERE c.taken AND (p.merged < c.merged OR q.merged < c.merged) GROUP BY c.word),
   done AS (SELECT c.word, c.pos, c.token, c.turn, c.merged, c.taken AND c.pos <= coalesce(w.pos, c.pos) AS hit FROM sided c LEFT JOIN wakes w ON w.word = c.word)
   SELECT word, pos, CASE WHEN hit THEN merged ELSE token END, turn + 1
   FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS eaten FROM done) WHERE NOT eaten)
)
SELECT word, pos, token FROM (SELECT word, pos, token, turn, max(turn) OVER (PARTITION BY word) AS last FROM step) WHERE turn = last ORDER BY word, pos
"""
#: Rows are put in order once and aggregated as they come: with one thread and insertion order preserved, as set below, a group's rows keep it. An order
#: inside the aggregate takes 2.5 times as long.
DECODE = """
SELECT doc, sha256(unhex(string_agg(hex, ''))) AS digest
FROM (SELECT doc, hex FROM ids JOIN vocabulary USING (token) ORDER BY pos) GROUP BY doc
"""


def kept_half(held: dict, most: int) -> None:
    """Beyond ``most`` entries only the older half stays: frequent words come early."""
    if len(held) > most:
        older = list(islice(held.items(), most // 2))
        held.clear()
        held.update(older)


class Codec:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, ranks: str, pattern: str):
        lines = (x.split() for x in open(ranks, "rb"))
        self.tokens = {base64.b64decode(a): int(b) for a, b in lines}
        if max(self.tokens.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits here")
        self.pieces = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.single = [self.tokens[bytes([b])] for b in range(256)]
        merges = [(self.tokens[t[:k]], self.tokens[t[k:]], n) for t, n in self.tokens.items() for k in range(1, len(t)) if t[:k] in self.tokens and t[k:] in self.tokens]
        self.inside = np.zeros((256, 256), bool)  # byte pairs that occur in a token
        for t in self.tokens:
            at = np.frombuffer(t, np.uint8)
            self.inside[at[:-1], at[1:]] = True
        spill = os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).partition(",")[0], f"bpe-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": spill})
        self.db.execute("SET preserve_insertion_order = true").fetchall()
        for name, frame in (
            ("merges", pd.DataFrame(merges, columns=["l", "r", "merged"], dtype=np.int32)),
            ("vocabulary", pd.DataFrame({"token": np.fromiter(self.tokens.values(), np.int32), "hex": [t.hex() for t in self.tokens]})),
        ):
            self.db.register("frame", frame)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM frame").fetchall()
            self.db.unregister("frame")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _query(self, query: str, symbols: pa.Table) -> dict[str, np.ndarray]:
        self.db.register("symbols", symbols)
        found = self.db.execute(query).fetchnumpy()
        self.db.unregister("symbols")
        return found

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        each = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        token = np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        end = np.zeros(len(each), bool)
        end[np.cumsum(sizes) - 1] = True
        symbols = {"word": each, "pos": pos, "token": token, "after": pa.array(pos + 1, mask=end), "next": pa.array(np.r_[token[1:], np.int32(0)], mask=end)}
        found, before = self._query(query, pa.table(symbols)), len(each)
        while query is LONG and len(found["token"]) < before:
            before = len(found["token"])
            found = self._query(query, pa.table({c: found[c] for c in ("word", "pos", "token")}))
        ends = np.searchsorted(found["word"], np.arange(len(words)), side="right")
        ids, cuts = found["token"].astype("<u2").tobytes(), [0, *(2 * ends).tolist()]
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def parted(self, word: bytes) -> list[bytes]:
        """A long word, cut between two bytes that no token holds side by side: no merge ever crosses there."""
        at = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.inside[at[:-1], at[1:]]) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_words(self, words: list[bytes], at_once: int = 800_000) -> dict[bytes, bytes]:
        """Ids, 16 bits each, of separate matches of the pattern."""
        out = {w: self.tokens[w].to_bytes(2, "little") for w in words if w in self.tokens}
        long = {w: self.parted(w) for w in words if w not in out and len(w) > LONGEST}
        parts = {x for xs in long.values() for x in xs}
        out |= {x: self.tokens[x].to_bytes(2, "little") for x in parts if x in self.tokens}
        rest = sorted((x for x in {*words, *parts} if x not in out and (x in parts or x not in long)), key=len)
        at = 0
        while at < len(rest):
            short, n, to = len(rest[at]) <= LONGEST, 0, at
            while to < len(rest) and (to == at or n + len(rest[to]) <= at_once) and (len(rest[to]) <= LONGEST) == short:
                n, to = n + len(rest[to]), to + 1
            out |= zip(rest[at:to], self._contract(rest[at:to], SHORT if short else LONG))
            at = to
        return out | {w: b"".join([out[x] for x in xs]) for w, xs in long.items()}

    def _learn(self, chunks: set[str]) -> None:
        split = {c: self.pieces.findall(c) for c in chunks}
        new = {x for xs in split.values() for x in xs} - self.words.keys()
        ids = self.encode_words([x.encode() for x in new])
        self.words |= {x: ids[x.encode()] for x in new}
        self.chunks |= {c: b"".join([self.words[x] for x in xs]) for c, xs in split.items()}
        kept_half(self.words, MOST_WORDS)

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids, 16 bits each, of whole texts. Texts are cut before spaces, where no match crosses; each distinct cut is encoded once."""
        cut = [self.pieces.findall(t) if UNSAFE.search(t) else t.replace(" ", "\0 ").split("\0") if "\0" not in t else self.pieces.findall(t) for t in docs]
        self._learn({x for xs in cut for x in xs} - self.chunks.keys())
        out = [b"".join(map(self.chunks.__getitem__, xs)) for xs in cut]
        kept_half(self.chunks, MOST_CHUNKS)
        return out

    def decode(self, docs: list[bytes]) -> list[str]:
        """SHA-256 of the decoded bytes of each document's ids (16 bits each): token-position rows, aggregated in order."""
        sizes = np.fromiter((len(x) // 2 for x in docs), np.int64, len(docs))
        each = np.repeat(np.arange(len(docs)), sizes)
        rows = pa.table({"doc": pa.array(each.astype(np.int32)), "pos": pa.array(np.arange(len(each), dtype=np.int64)), "token": pa.array(np.frombuffer(b"".join(docs), "<u2").astype(np.int32))})
        self.db.register("ids", rows)
        found = self.db.execute(DECODE).fetchnumpy()
        self.db.unregister("ids")
        out = [EMPTY] * len(docs)
        for d, x in zip(found["doc"].tolist(), found["digest"].tolist()):
            out[d] = x
        return out


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes


@lru_cache(2)
def codec(ranks: str, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids (binary: little-endian unsigned 32-bit token ids) and decoded_sha256 to ``docs``; a column of these names is replaced.

    Each match of ``pattern`` is encoded by itself: of its neighbouring tokens the leftmost pair whose joined bytes have the least
    rank is merged until no joined pair is a token, in a recursive query of DuckDB over rows (word, position, token). Null texts count as
    empty; empty texts have no ids. Long texts go whole; documents are decoded in groups of about ``MOST_TOKENS`` tokens.
    An empty table gives an empty result. ``ranks`` is a file that all executors have.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("ids", "decoded_sha256")]
    schema = docs.select(*names, F.lit(b"").alias("ids"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            ids = c.encode([x or "" for x in b.column(names.index(text)).to_pylist()])
            digests: list[str] = []
            part, n = [], 0
            for x in ids:
                part.append(x)
                n += len(x) // 2
                if n > MOST_TOKENS:
                    digests += c.decode(part)
                    part, n = [], 0
            if part:
                digests += c.decode(part)
            wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(wide, pa.binary()), pa.array(digests, pa.string())], [*names, "ids", "decoded_sha256"])

    return docs.select(*names).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded: (doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row; null texts have no tokens."""
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
