"""Exact dedup by keyed streaming state against plain grouping."""

from __future__ import annotations

import hashlib
import random
import string

from pyspark.sql import functions as F

from latticework.llm import exact_dedup as ed
from latticework.llm.common import with_groups

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """(id, keep_id, size, sha) of all rows, and for each text how many rows stay: one."""
    by: dict[str, list] = {}
    for i, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((i, keep[t := (x or "").translate(LOWER)], len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, x in rows), key=repr), len(by)


def written(spark, tmp_path, rows, name="docs", mode="append", files=3):
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 digest", "2 n", "'f' file", "3 row", "4 keep", "5 id", "6 body", "7 `_metadata`").repartition(files).write.mode(mode).parquet(path)
    return path


def found(df):
    rows = df.collect()
    kept = [r for r in rows if r.kept]
    assert all(r.id == r.keep_id for r in kept)
    return sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr), len(kept)


def rows_of(n, seed=5):
    draw = random.Random(seed)
    texts = [None, "", " ", "One", "one", "ONE", "ÉTÉ", "été", "a\nb", "x" * 200_000, "X" * 200_000, "😀"] + [f"text {k}" for k in range(n // 4)]
    return [(k, draw.choice(texts)) for k in range(n)]


def test_equals_grouping(spark, tmp_path):
    rows = rows_of(600) + [(10_000 + k, "A hot text") for k in range(2000)] + [(None, "One"), (None, "only null ids"), (None, "only null ids"), (5, "same id"), (5, "same id"), (5, "another text")]
    assert found(ed.decisions(spark, written(spark, tmp_path, rows))) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert found(ed.decisions(spark, written(spark, tmp_path, [], files=1))) == ([], 0)


def test_bytes_decide_where_digests_clash(spark, tmp_path):
    """A digest of eight values: nearly all hits differ in their bytes."""
    rows = rows_of(300)
    weak = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))
    got, kept = found(ed.decisions(spark, written(spark, tmp_path, rows), digest=weak))
    want, n = plain(rows)
    assert kept == n and [r[:3] for r in got] == [r[:3] for r in want]


def test_a_later_run_reads_new_files_alone_and_remembers(spark, tmp_path):
    first, second = rows_of(200, 1), [(k + 1000, t) for k, t in rows_of(200, 2)]
    state = f"file://{tmp_path}/state"
    path = written(spark, tmp_path, first)
    assert found(ed.decisions(spark, path, state=state)) == plain(first)
    written(spark, tmp_path, second)
    assert found(ed.decisions(spark, path, state=state)) == plain(first + second)
    import json

    batches = sorted((tmp_path / "state" / "sources" / "0").glob("[0-9]*"), key=lambda p: int(p.name.split(".")[0]))
    files = [json.loads(x)["path"] for b in batches for x in b.read_text().splitlines()[1:]]
    assert len(batches) == 2 and len(files) == len(set(files))


def test_unique_rows_keep_their_columns(spark, tmp_path):
    rows = rows_of(200)
    path = written(spark, tmp_path, rows)
    stay = ed.unique_rows(spark, path)
    assert stay.columns == spark.read.parquet(path).columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({r[1] for r in plain(rows)[0]})


def test_only_sql_functions(spark, tmp_path):
    """The main path has no Python in its plans."""
    path = written(spark, tmp_path, rows_of(50))
    held = ed.retained(spark, path, f"file://{tmp_path}/seen")
    plans = [ed.collisions(ed.marked(spark, path, held)), ed.decisions(spark, path)]
    assert not any(word in p._jdf.queryExecution().toString() for p in plans for word in ("Python", "Pandas", "Arrow"))


def test_with_groups_meets_hot_and_other_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2500, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    groups = rows.where("k is not null and id % 7 <> 3").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {r.id: (r.n, r.top) for r in with_groups(rows, groups, "k", "n", 5001, F.col("id")).collect()}
    want = {r.k: (r.n, r.top) for r in groups.collect()}
    assert got == {r.id: want.get(r.k, (None, None)) for r in rows.collect()}
