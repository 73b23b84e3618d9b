"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns, against brute force."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm import ann, bpe, embedding_dedup, line_dedup, packing, quality, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from latticework.llm.common import components
from latticework.llm.induced_sorting import suffix_order

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
PASSAGE = " ".join(f"w{k}" for k in range(70))
TEXTS = [
    "", None, "  \n\t ", "one", "A b c d e f\nline two here\nline three here\nend", "x y\nline two here\nline three here\nz", f"before {PASSAGE} after", f"other {PASSAGE} tail", f"other {PASSAGE} tail",
    "naïve café ß 🙂 it's  I'LL\r\n\r\n  12345 ", "ab " * 400, "q" * 1500, "the quick brown fox jumps over the lazy dog again and again until night falls", "The Quick brown fox jumps over the lazy dog again and again until night falls",
]
SCHEMA = "doc_id long, text string, n_words string, kept int, ids int, score string, key string, starts int, found string, _id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "clash", 1, 2, "s", "k", 3, "f", 4) for k, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t: str | None) -> list[str]:
    return [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]


def test_bpe_equals_the_library(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encoded(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_simhash_components(docs, none, spark):
    twice = docs.unionByName(docs.where("doc_id = 4"))
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.near_duplicates(twice).collect()}

    def fp(t: str | None) -> int:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [fp(t) for t in TEXTS]
    assert [found[k][0] for k in range(len(TEXTS))] == want
    label = list(range(len(TEXTS)))
    for _ in label:
        label = [min(label[j] for j in range(len(TEXTS)) if (want[i] ^ want[j]).bit_count() <= 4) for i in range(len(TEXTS))]
    assert [found[k][1] for k in range(len(TEXTS))] == label
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_similar_documents_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = [[f"v{x}" for x in rng.integers(0, 5000, n)] for n in (4, 5, 9, 30, 60, 120, 300)]
    made = [[], []]
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            c = list(b)
            for at in rng.integers(0, len(c), edits):
                c[at] = f"z{rng.integers(0, 10**9)}"
            made.append(c)
    made += [[*base[5][:110], f"tail{k}"] for k in range(40)] + [[*base[4], *(f"own{k}x{j}" for j in range(60))] for k in range(40)]
    order = rng.permutation(len(made))
    made = [made[k] for k in order]
    sets = [{tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set() for w in made]
    label = list(range(len(made)))
    near = [[j for j in range(len(made)) if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in range(len(made))]
    for _ in label:
        label = [min(label[j] for j in near[i]) for i in range(len(made))]
    docs = spark.createDataFrame([(k, " ".join(w) if w else None) for k, w in enumerate(made)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs).collect()}
    assert [found[k] for k in range(len(made))] == label
    four = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
    assert len(set(found.values())) < len(set(four.values()))
    assert simhash_dedup.similar_documents(docs.limit(0)).count() == 0


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in a], dtype=np.uint64)
    rows, keys = simhash_dedup.fuzzy_keys(np.concatenate([a, a ^ flips]))
    by = defaultdict(set)
    for r, k in zip(rows.tolist(), keys.tolist()):
        by[r].add(k)
    assert all(by[k] & by[k + 300] for k in range(300))


def test_components_of_a_hub_and_a_path(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)], "a long, b long")
    found = {r.id: r.root for r in components(edges, "test").collect()}
    assert found == {**{k: 0 for k in range(60)}, **{k: 100 for k in range(100, 131)}}


@pytest.mark.parametrize("least", [1, 10, 24, 60])
def test_line_dedup(docs, none, spark, least):
    """Every run of lines is compared with every other."""
    more = ["a\nbb\nccc\nlonger line of its own here\nd\ne", "x\nbb\nccc\nlonger line of its own here\nd\nq", "bb\nccc\n\nlonger line of its own here\ne", "ab\nab\nab\n" * 6, "a text of one line, copied", "a text of one line, copied"]
    rows = docs.unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    rows = rows.unionByName(docs.where("doc_id = 5"))  # a repeated row
    found = {r.doc_id: r for r in line_dedup.without_repeats(rows, least).collect()}
    texts = {**dict(enumerate(TEXTS)), **{100 + k: t for k, t in enumerate(more)}}
    counting = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for i, t in texts.items()}
    firsts: dict[tuple, tuple] = {}
    runs = [(i, s, e) for i, c in counting.items() for s in range(len(c)) for e in range(s + 1, len(c) + 1)]
    for i, s, e in runs:
        run = tuple(x for _, x in counting[i][s:e])
        firsts[run] = min(firsts.get(run, (i, s)), (i, s))
    gone = defaultdict(set)
    for i, s, e in runs:
        run = tuple(x for _, x in counting[i][s:e])
        if sum(len(x.encode()) for x in run) >= least and firsts[run] < (i, s):
            gone[i] |= {k for k, _ in counting[i][s:e]}
    for i, t in texts.items():
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert (found[i].text, found[i].n_removed_lines) == (want, len(gone[i]))
    assert found[4].n_words == "clash" and line_dedup.without_repeats(none, least).count() == 0


@pytest.mark.parametrize("log2", [None, 99])  # 99: the sketch stays in the cluster
def test_substring_dedup(docs, none, log2):
    found = {r.doc_id: r for r in substring_dedup.without_repeats(docs, log2=log2).collect()}
    seen: dict[tuple, int] = {}
    for k, t in enumerate(TEXTS):
        w = words(t)
        for s in range(len(w) - 49):
            seen.setdefault(tuple(w[s : s + 50]), k)
    for k, t in enumerate(TEXTS):
        w = words(t)
        gone = {s + j for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] < k for j in range(50)}
        assert (found[k].n_words, found[k].n_removed) == (len(w), len(gone))
        assert found[k].kept == (None if t is None else " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substring_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize(("crowd", "log2"), [(1, None), (512, 99)])
def test_suffix_dedup(docs, none, crowd, log2, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    found = {r.doc_id: r for r in suffix_dedup.without_repeats(docs.drop("kept"), 100, log2).collect()}
    raw = [(t or "").encode() for t in TEXTS]
    count = Counter(b[s : s + 100] for b in raw for s in range(len(b) - 99))
    for k, b in enumerate(raw):
        gone = {s + j for s in range(len(b) - 99) if count[b[s : s + 100]] > 1 for j in range(100)}
        assert (found[k].n_bytes, found[k].n_removed) == (len(b), len(gone))
        assert found[k].n_spans == sum(1 for j in gone if j - 1 not in gone)
        assert bytes(found[k].kept) == bytes(x for j, x in enumerate(b) if j not in gone)
    assert suffix_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("room", [64, 1 << 20])
def test_suffix_order(room):
    rng = np.random.default_rng(1)
    for n in range(1, 80):
        t = rng.integers(0, 1 + n % 4, n).astype(np.uint8)
        assert suffix_order(t, 1 << 20, room).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_signs_of_linked_vectors_stay_within_the_limit():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    apart = np.bitwise_count((embedding_dedup.signs(a) ^ embedding_dedup.signs(b)).view(np.uint64)).sum(1)
    assert apart.max() <= embedding_dedup.most_signs(0.95) < 100


def test_packing_equals_the_library(docs, none):
    library = Tokenizer.from_file(WORDS)
    by = defaultdict(list)
    rows = packing.pieces(docs, WORDS).collect()
    for r in rows:
        by[r.doc_id].append(r)
    for k, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[k], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == ids and all(r.doc_tokens == len(ids) for r in parts)
        assert all(r.length.bit_count() == 1 and r.length <= 4096 and r.length == 1 << r.bucket for r in parts)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pieces(none, WORDS).count() == 0


def test_classifiers_separate_held_out_texts(spark, docs, none):
    rng = np.random.default_rng(2)
    stock = ["".join(rng.choice(["the", "an", "er", "on", "re", "sh"], 3)) for _ in range(300)]
    text = lambda: " ".join(rng.choice(stock, 60))
    bad = lambda: text().replace(" ", " idiot ", 1).replace(" ", " worthless ", 1)
    m = toxicity.train([bad() for _ in range(120)], [text() for _ in range(120)])
    new = spark.createDataFrame([(k, bad() if k % 2 else text()) for k in range(60)], "doc_id long, text string")
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in toxicity.scored(new, m).collect()]) >= 0.9
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, m).collect()) and toxicity.scored(none, m).count() == 0
    good = [text().capitalize() + "." for _ in range(80)]
    q = quality.train(good, [text().upper().replace(" ", "!! ") for _ in range(80)], 0.5)
    fresh = spark.createDataFrame([(k, text().upper().replace(" ", "!! ") if k % 2 else text().capitalize() + ".") for k in range(40)], "doc_id long, text string")
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in quality.scored(fresh, q).collect()]) >= 0.9
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, q).collect()) and quality.scored(none, q).count() == 0


def test_machine_equals_pairwise_sum():
    m = quality.train(["one two three", "four five"], ["SIX!! SEVEN!!", "EIGHT!!"], 0.5, epochs=1)
    index, x = m.features(b"one SIX!! nine")
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(m.raw(index, x) - (m.constant + m.linear[index] @ x + pairs)) < 1e-9


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 20))
    base[60:90] = base[:30] + rng.normal(size=(30, 20)) * 0.05
    base[90:100] = base[0]
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(200, None), (201, [0.0] * 20), (202, [float("nan")] * 20), (203, [1.0, None] * 10), (250, [1.0, 2.0, 3.0]), (251, [2.0, 4.0, 6.0])]
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], "vec_id long, embedding array<double>, label int, id string")


def unit_rows(vectors):
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    return {k: v / np.linalg.norm(v) for k, v in rows.items()}


def test_nearest(vectors):
    u = unit_rows(vectors)
    found = defaultdict(list)
    for r in ann.nearest(vectors, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert set(found) == {k for k in u if k % 10 == 0}
    for q, got in found.items():
        all_ = sorted((-round(float(u[q] @ u[k]), 9), k) for k in u if k != q and len(u[k]) == len(u[q]))[:5]
        assert [s for _, s in got] == [-s for s, _ in all_] and (q == 90 or [i for i, _ in got] == [k for _, k in all_])
    assert ann.nearest(vectors.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("of_shape", [None, (20, 3)])
def test_embedding_links(vectors, of_shape):
    u = unit_rows(vectors)
    links = {k: {j for j in u if j != k and len(u[j]) == len(u[k]) and u[k] @ u[j] >= 0.95} for k in u}
    root = {r.vec_id: r.vec_id for r in vectors.collect()}
    for _ in root:
        root = {k: min([r, *(root[j] for j in links.get(k, ()))]) for k, r in root.items()}
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors, of_shape=of_shape).collect()}
    assert found.keys() == root.keys()
    assert all((r.n_links, r.component_id, r.kept) == (len(links.get(k, ())), root[k], root[k] == k) for k, r in found.items())
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_planted_links_of_64_dimensions_are_found(spark):
    """Clusters at cosines around the limit among unlike vectors, one group larger than a block's side, repeated rows with one vec_id."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = lambda a, c: c * a + np.sqrt(1 - c * c) * (r := (x := rng.normal(size=64)) - (x @ a) * a) / np.linalg.norm(r)  # noqa: E731, F821
    rows = [*base, *(near(base[k % 40], c) for k in range(200) for c in (0.951, 0.97)), *(base[50] + rng.normal(size=64) * 0.003 for _ in range(1200))]
    v = np.array(rows)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    docs = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(docs).collect()}
    assert [found[k].n_links for k in range(len(v))] == linked.sum(1).tolist()
    label = np.arange(len(v))
    while True:
        low = np.array([min(label[k], label[linked[k]].min(initial=len(v))) for k in range(len(v))])
        if (low == label).all():
            break
        label = low
    assert [found[k].component_id for k in range(len(v))] == label.tolist()
