"""The registered queries: rows against DuckDB where SQL expresses them, against brute force otherwise."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from latticework.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'").fetchall()
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    sql = registry.oracle_sql()[name]
    assert isinstance(sql, str)
    ours, theirs = ordered(registry.queries()[name](spark, DATA).toPandas()), ordered(db.execute(sql).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=False, rtol=0, atol=1e-12)
    assert len(ours)


def test_op1(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {k: np.array(library.encode_ordinary(t), "<u4") for k, t in texts.items()}
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.queries()["op1_bpe"](spark, DATA).collect()}
    assert found == {(k, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest()) for k, x in ids.items()}


def test_op2(spark, texts):
    def fp(t: str) -> int:
        w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t).encode())]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {k: fp(t) for k, t in texts.items()}
    keys, v = list(want), np.array(list(want.values()), np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.array(keys)
    while True:
        low = np.array([label[m].min() for m in near])
        if (low == label).all():
            break
        label = low
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in registry.queries()["op2_simhash_dedup"](spark, DATA).collect()}
    assert found == {(k, f"{want[k]:016x}", int(c)) for k, c in zip(keys, label)}


def test_op7(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = registry.queries()["op7_packing"](spark, DATA).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys() and len({r.sequence_id for r in rows}) == len(rows)
    for k, t in texts.items():
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens, r.ids_crc32) == (at, 0, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())) and r.length & r.length - 1 == 0 and r.length <= 4096
            at += r.length
        assert at == len(ids)


#: On sf0.1: sf0.01 holds out only 11 rows of bad quality.
@pytest.mark.parametrize(("name", "label", "limit", "data", "recall", "alarms"), [("op5_toxicity", "toxic", 0.5, "sf0.1", 0.75, 0.01), ("op8_quality", "quality", 0.3, "sf0.1", 0.97, 0.05)])
def test_classifiers_on_held_out_rows(spark, name, label, limit, data, recall, alarms):
    d = f"/root/testdata/{data}"
    found = registry.queries()[name](spark, d).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(found) == docs and found.score.between(0, 1).all() and (found.predicted == (found.score >= limit)).all()
    assert (found.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in found.index]).all()
    marked = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")[label].dropna()
    both = found.join(marked, how="inner")
    both = both[both.held_out]
    assert both.predicted[both[label] == 1].mean() >= recall and both.predicted[both[label] == 0].mean() <= alarms
