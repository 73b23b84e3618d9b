"""The pipeline on small tables: every stage's decisions take effect, and packing holds what the stages before kept."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from latticework.llm.common import table, written

DATA = "/root/testdata/sf0.01"
COPIES = range(10_000_000, 10_000_400)


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() <= before
        before = docs.count()
        if stage is corpus_pipeline.quality_filter:
            stay = {r.doc_id for r in docs.select("doc_id").collect()}
            assert np.mean([k in stay for k, q in labels.items() if q == 1]) >= 0.97
            assert np.mean([k not in stay for k, q in labels.items() if q == 0]) >= 0.9
    kept = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).orderBy("doc_id", "start").collect()
    ids: dict[int, bytes] = {}
    for r in pieces:
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t in kept.items()}


def test_one_of_many_copies_stays(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    good = table(spark, DATA, "labels").where("quality = 1").select("doc_id")
    of = docs.join(good, "doc_id").where("n_chars > 500").orderBy("doc_id").first()
    copies = spark.range(COPIES.start, COPIES.stop).selectExpr("id doc_id").crossJoin(docs.where(docs.doc_id == of.doc_id).drop("doc_id"))
    docs.unionByName(copies).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, DATA, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert len(kept) > 100 and len(kept & {of.doc_id, *COPIES}) <= 1


def test_near_copies_of_the_stage(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:95], "other"])), (3, " ".join(words[:50] + [f"x{k}" for k in range(50)])), (4, ""), (5, " "), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()} == {1, 3, 4}


def test_the_line_stage_drops_single_lines_and_copied_one_line_texts(spark):
    rows = [(1, "licence line\nfirst text"), (2, "second text\nlicence line\nits end"), (3, "a text of one line"), (4, "a text of one line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    found = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, DATA).collect()}
    assert found == {1: rows[0][1], 2: "second text\nits end", 3: rows[2][1], 4: ""}
