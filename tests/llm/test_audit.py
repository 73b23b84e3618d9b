"""The filter interaction audit against a plain walk through every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from latticework.llm import filter_audit as fa


def brute(docs, labels):
    """Every order applied to every document."""
    first: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        rows.append((lang or "", "".join(k for k, v in fails.items() if v), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, value = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order, 1):
                here = [n for n, r in enumerate(own) if f in r[1] and n not in gone]
                again = sum(f in r[1] and n in gone for n, r in enumerate(own))
                gone |= {*here}
                value[f] += len(here)
                out[part, "".join(order), k] = [len(own) - len(gone), len(here), again, sum(r[1] == f for r in own), sum(own[n][2] for n in here), sum(own[n][3] for n in here), f]
        for key, row in out.items():
            if key[0] == part and isinstance(row[6], str):
                row[6] = value[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def of(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 part", "2 mask", "3 digest", "4 size", "5 words", "6 n")
    rows = fa.document_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 id", "'x' good")).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def test_equals_every_order_applied(spark):
    draw = random.Random(3)
    long = lambda n, kinds: " ".join(draw.choice(kinds) for _ in range(n))
    many = [f"word{k}" for k in range(2000)]
    texts = [None, "", " \t\n", "short", "Costs $5", long(200, many), long(199, many), long(300, ["a", "b"]), long(250, many) + " |", long(250, [w.upper() for w in many]), "ÄÖÜ é 😀 " * 100, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "x" * 300_000, "\x85 \xa0 " * 300]
    docs = [(k, draw.choice(texts), draw.choice(["en", "de", None, ""])) for k in range(400)]
    docs += [(None, "short", "en"), (None, "short", "fr"), (7, "short", "en"), (7, "short", "en"), (500, "a hot text", "en")] + [(k, "a hot text", "en") for k in range(501, 900)]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, 600, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    assert of(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert of(spark, [], []) == {}
    assert of(spark, [(1, None, None)], []) == brute([(1, None, None)], [])


def test_potentials_of_any_game():
    """Shapley by the potential equals the mean over all orders; potentials meet their defining sum."""
    draw = random.Random(1)
    for n in (1, 2, 3, 5):
        worth = [0] + [draw.randrange(100) for _ in range((1 << n) - 1)]
        want = [0] * n
        for order in permutations(range(n)):
            s = 0
            for k in order:
                want[k] += worth[s | 1 << k] - worth[s]
                s |= 1 << k
        assert fa.shapley(worth) == want and sum(fa.shapley(worth)) == len(list(permutations(range(n)))) * worth[-1]
        p = fa.potentials(worth)
        for s in range(1 << n):
            assert sum(p[s] - p[s & ~(1 << k)] for k in range(n) if s >> k & 1) == len(list(permutations(range(n)))) * worth[s]
