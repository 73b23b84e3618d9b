"""The pipeline's near-duplicate stage: SimHash links, exact links, and groups that need both."""

from __future__ import annotations

import random

import corpus_pipeline
from latticework.llm import common, line_dedup, packing, quality, simhash_dedup, substring_dedup

DATA = "/root/testdata/sf0.01"


def test_fingerprints_link_what_sets_of_runs_do_not(spark):
    cycle = " ".join([f"w{k}" for k in range(10)] * 100)
    rows = [(1, cycle), (2, cycle + " " + " ".join(f"x{k}" for k in range(12))), (3, " ".join(f"y{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    similar = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs).collect()}
    assert similar == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()} == {1, 3}


def test_components_take_no_step_to_confirm_stars(spark, monkeypatch):
    """What the driver plans and runs: a table of the edges and one for each step that changes them, none for an empty table."""
    made = []
    real = common.written
    monkeypatch.setattr(common, "written", lambda df, label: made.append(label) or real(df, label))
    cases = (([], {}, 1), ([(5, 2), (7, 2), (9, 8), (8, 9), (4, 4)], {2: 2, 5: 2, 7: 2, 8: 8, 9: 8}, 1), ([(k, k + 1) for k in range(40)], dict.fromkeys(range(41), 0), None), ([(1, 3), (2, 3), (1, 2)], {1: 1, 2: 1, 3: 1}, 2))
    for edges, roots, tables in cases:
        made.clear()
        found = common.components(spark.createDataFrame(edges, "a long, b long"), "cc").collect()
        assert {r.id: r.root for r in found} == roots and len(found) == len(roots)
        assert tables in (None, len(made))


def test_word_cache_of_the_quality_stage_is_bounded():
    """It outlives its stage in each Python worker; a cleared cache gives the same features."""
    text = " ".join(f"v{k}" for k in range(100)).encode()
    before = quality.document(text)
    quality.document(" ".join(f"u{k}" for k in range(250_000)).encode())
    assert len(quality._hashes) <= 100_000
    assert all((a == b).all() for a, b in zip(before, quality.document(text)))


def test_a_worker_holds_one_cache_of_words():
    """Python workers run all stages: what one remembers must not stay beside the next one's."""
    import public_tokenizers

    text = " ".join(f"v{k}" for k in range(1000))
    ids = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    first = ids.encode([text])
    before = [simhash_dedup.shingles(text.encode(), 5), quality.document(text.encode())[0], substring_dedup.window_keys(text.encode(), 50, 24)[0]]
    assert not ids.held and not ids.pieces and not simhash_dedup._words and not quality._hashes and len(substring_dedup._words) == 1000
    assert ids.encode([text]) == first and not substring_dedup._words
    after = [simhash_dedup.shingles(text.encode(), 5), quality.document(text.encode())[0], substring_dedup.window_keys(text.encode(), 50, 24)[0]]
    assert all((a == b).all() for a, b in zip(before, after))


def test_components_make_no_rows_of_nodes_without_hubs(spark, monkeypatch):
    """A node's least neighbour goes only where it has edges: no step makes ``salts`` rows of each node, and hubs still come out right."""
    plans = []
    real = common.written
    monkeypatch.setattr(common, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    edges = [(k, 0) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1030)] + [(2000, 2001)]
    found = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "cc").collect()}
    assert found == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1031)} | {2000: 2000, 2001: 2000}
    assert len(plans) > 1 and not any("Generate" in p for p in plans)


def test_no_side_of_a_join_is_broadcast_by_its_estimate(spark, monkeypatch):
    """Keys made of fingerprints, or rows of arrays, are many times the files that Spark sizes them by: small tables show which joins it would broadcast."""
    plans = []
    real = common.written
    kept = lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label)
    for module in (common, line_dedup, simhash_dedup, substring_dedup):
        monkeypatch.setattr(module, "written", kept)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for made in (simhash_dedup.near_duplicates(docs), corpus_pipeline.drop_repeated_lines(spark, docs, DATA), corpus_pipeline.drop_near_duplicates(spark, docs, DATA), corpus_pipeline.drop_repeated_passages(spark, docs, DATA)):
        plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_more_runs_than_cells_leave_unlike_texts_out(spark, monkeypatch):
    """A sketch with more marks than cells tells nothing: texts without a partner must still not reach the sets, and no pair may be lost."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**9)}"
    rows = {k: [word() for _ in range(120)] for k in range(60)}
    for k in range(10):
        rows[100 + k] = rows[k][:115] + [word() for _ in range(5)]
    rows |= {200: ["a", "b"], 201: ["a", "b"], 202: [], 203: [], 204: rows[20], 205: rows[30][:60] + [word() for _ in range(60)]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    seen = {}
    real = simhash_dedup.written
    monkeypatch.setattr(simhash_dedup, "written", lambda df, label: seen.__setitem__(label, real(df, label)) or seen[label])
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs, most_log2=8).collect()}
    assert found == {k: k for k in rows} | {100 + k: k for k in range(10)} | {201: 200, 203: 202, 204: 20}
    assert seen["similar-sets"].count() < 40 and seen["similar-some"].count() < 40
