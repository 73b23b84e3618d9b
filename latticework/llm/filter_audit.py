"""Filter interaction audit: the removal game of several filters, its Hart-Mas-Colell potentials over all coalitions, Shapley values and every order's steps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table, with_groups, written

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def potentials(worth: list[int]) -> list[int]:
    """n! times the potential of every coalition (a bit mask) of n players; ``worth`` has what each coalition removes, nothing for the empty one.

    P of a coalition is its worth and the potentials of all coalitions with one player less, by its number of players. Whole numbers: a dividend of k players
    enters P divided by k.
    """
    n = (len(worth) - 1).bit_length()
    p = [0] * len(worth)
    for s in range(1, len(worth)):
        p[s] = (math.factorial(n) * worth[s] + sum(p[s & ~(1 << k)] for k in range(n) if s >> k & 1)) // s.bit_count()
    return p


def shapley(worth: list[int]) -> list[int]:
    """n! times each player's Shapley value: the grand potential less the one without the player."""
    p = potentials(worth)
    return [p[-1] - p[len(worth) - 1 & ~(1 << k)] for k in range((len(worth) - 1).bit_length())]


def steps(part: str, total: int, removed: list[int], good: list[int], toxic: list[int], letters: str) -> list[tuple]:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders; differences of coalitions' worths."""
    everyone, value, out = len(removed) - 1, shapley(removed), []
    for order in permutations(range(len(letters))):
        before = 0
        for at, k in enumerate(order, 1):
            after = before | 1 << k
            here = removed[after] - removed[before]
            out.append((
                part, "".join(letters[x] for x in order), at, total - removed[after], here, removed[1 << k] - here,
                removed[everyone] - removed[everyone & ~(1 << k)], good[after] - good[before], toxic[after] - toxic[before], value[k],
            ))
            before = after
    return out


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(rows: DataFrame, failures: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """``OUT`` for each part, order of the filters (one letter each) and step.

    ``failures``: each filter's condition; null counts as false. Null and empty parts are one, "". A row's mask of failed filters is all that counts:
    sums over masks that meet a coalition are its worth, so a part is one row of three times 2^n numbers after partial sums. No rows, no parts.
    """
    letters, n = "".join(failures), len(failures)
    mask = sum((F.coalesce(c.cast("int"), F.lit(0)) * (1 << k) for k, c in enumerate(failures.values())), F.lit(0))
    marked = rows.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"))
    hit = [F.col("mask").bitwiseAND(s) != 0 for s in range(1 << n)]
    sums = lambda also: F.array(*(F.count_if(h & also) for h in hit))
    worth = marked.groupBy("part").agg(F.count("*").alias("total"), sums(F.lit(True)).alias("removed"), sums(F.col("good")).alias("good"), sums(F.col("toxic")).alias("toxic"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUT.split(", ")]
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame(steps(r.part, int(r.total), *([int(x) for x in v] for v in (r.removed, r.good, r.toxic)), letters), columns=names)

    return worth.mapInPandas(run, OUT)


def facts(docs: DataFrame) -> DataFrame:
    """(id, part, digest, few, poor, loud, marks): what the conditions of A to D say of each document's whole text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    counted = docs.withColumn("words", words).withColumn("n", F.size("words"))
    capitals = F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return counted.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.col("n") < 200).alias("few"), (100 * F.size(F.array_distinct("words")) < 50 * F.col("n")).alias("poor"),
        (100 * capitals > 3 * F.char_length("text")).alias("loud"), F.col("text").rlike("[#$%&*|]").alias("marks"),
    )


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over documents (doc_id, text, lang) and labels (doc_id, quality, toxic): A few words, B repeated words, C capitals, D marks, E copies.

    A copy is a text equal (by SHA-256) to that of a row with a smaller doc_id; rows with a null doc_id neither are copies nor make others copies. Of several
    label rows of one doc_id the larger values count; rows without labels are neither good nor toxic. Further columns are not read.
    """
    rows = written(facts(docs), "audit")
    groups = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    total = rows.count()
    rows = with_groups(rows, written(groups, "audit-copies"), "digest", "size", total, F.xxhash64("id"))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "id", "left")
    failures = {"A": F.col("few"), "B": F.col("poor"), "C": F.col("loud"), "D": F.col("marks"), "E": F.col("id") > F.col("first")}
    return audit(rows, failures, F.col("part"), F.col("good"), F.col("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all ``documents``, one row for each lang, order and step."""
    return document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
k AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)}} AS fails FROM w LEFT JOIN k USING (doc_id)),
fs AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed FROM f),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fs GROUP BY 1, 2),
orders(filter_order) AS (VALUES {', '.join(f"('{''.join(p)}')" for p in permutations(LETTERS))}),
s AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, n, n_good, n_toxic, failed,
  list_contains(failed, substr(filter_order, step, 1)) AS fails, len(list_filter(failed, lambda x: strpos(substr(filter_order, 1, step - 1), x) > 0)) > 0 AS gone FROM g, orders, range(1, 6) r(step)),
o AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND len(failed) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN n_good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM o
"""
