"""Packing by power-of-two decomposition: binary-length pieces of single documents, bucketed by length."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import only, small_batches, table

#: Control characters that Python, but not the tokenizer, takes for white space.
ODD = re.compile("[\x1c-\x1f]")
ASCII = re.compile("[!-~]+")
#: Fixed value: what the pre-tokenizer's pattern comes to on lower-case ASCII.
ASCII_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
MOST = 600_000  #: words that a Python worker remembers until another cache is in use


class WordIds:
    """Ids of texts by one tokenizer file whose pre-tokenizer never crosses white space; each distinct word is tokenized once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(True) > 1 << 16:
            raise ValueError("ids are kept in 16 bits here")
        self.held: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ascii(self, word: str) -> bytes:
        """Printable ASCII needs no normalizing but lower case, and its bytes stand for themselves: straight to the model."""
        out = []
        for piece in ASCII_PIECE.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(piece)], "<u2").tobytes()
            out.append(ids)
        return b"".join(out)

    def clear(self) -> None:
        self.held.clear()
        self.pieces.clear()

    def encode(self, docs: list[str]) -> list[bytes]:
        only(self)
        cut = [[t] if ODD.search(t) else t.split() for t in docs]
        new = set(chain.from_iterable(cut)) - self.held.keys()
        plain = {x for x in new if ASCII.fullmatch(x) and "<|" not in x}
        for x in plain:
            self.held[x] = self._ascii(x)
        rest = list(new - plain)
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            self.held.update(zip(part, (np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        out = [b"".join(map(self.held.__getitem__, xs)) for xs in cut]
        for held in (self.held, self.pieces):
            if len(held) > MOST:  # frequent words come early
                older = list(islice(held.items(), MOST // 2))
                held.clear()
                held.update(older)
        return out


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def piece_lengths(n: int, most: int) -> list[int]:
    """``n`` as powers of two of at most ``most``, longest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = 4096, text: str = "text") -> DataFrame:
    """Cuts each document's ids, with ``end_id`` after them, into pieces whose lengths are powers of two of at most ``most``.

    ``docs``: doc_id and ``text``; further columns are left out. Returns doc_id, start, length, ids (binary: little-endian unsigned 32-bit),
    doc_tokens, bucket (the length's exponent), sequence_id and offset. Each piece is a sequence of its own: no sequence
    crosses documents, none is padded, and batches are drawn from a bucket, where all lengths are equal. Null and empty texts give
    one piece with ``end_id`` alone; repeated rows are packed each by itself; an empty table gives no piece. sequence_id is unique.
    ``tokenizer`` is a file that all executors have; whole texts are tokenized, word by word, as their pre-tokenizer cuts
    them at white space in any case.
    """
    if most & most - 1:
        raise ValueError("most must be a power of two")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, end = word_ids(tokenizer), np.array([end_id], "<u4")
        for b in batches:
            out: list[tuple] = []
            for i, x in zip(b.column(0).to_pylist(), w.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.concatenate([np.frombuffer(x, "<u2").astype("<u4"), end])
                raw, start = ids.tobytes(), 0
                for n in piece_lengths(len(ids), most):
                    out.append((i, start, n, raw[4 * start : 4 * (start + n)], len(ids), n.bit_length() - 1))
                    start += n
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])

    cut = docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences with one folder for each length, from which batches of equal lengths are read."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all ``documents``: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); null texts are one piece, the end id alone."""
    import public_tokenizers

    return digests(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
