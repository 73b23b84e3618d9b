"""SimHash near-duplicates: Golay-code fuzzy keys, join, verification and components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import WORD, Rolling, WordHash, components, merged, small_batches, table, texts, written
from latticework.llm.sketch import LEAST_LOG2, ROOM, of_ids, prefilter

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Bytes of text for each run of words, about; cells of the sketch of such runs that is broadcast, and of the bits of documents, at most.
SPACING, CELLS_LOG2 = 6, 27
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_words, _runs = WordHash(3), Rolling(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of ``text``: XXH64 (seed 42) of every run of ``shingle`` words, repeats included; no words give 0."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, (ends[-n:] - 1).tolist())), dtype="<u8", count=n)
    for at in range(0, n, 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and high 12 bits, and error patterns of weight up to 4 by syndrome, lightest first, with offsets."""

    def remainder(x: int) -> int:
        for bit in range(23, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << bit - 11
        return x

    low, high = np.array([remainder(x) for x in range(4096)]), np.array([remainder(x << 12) for x in range(2048)])
    patterns = [sum(1 << b for b in at) for weight in range(5) for at in combinations(range(23), weight)]
    syndromes = np.array([low[p & 4095] ^ high[p >> 12] for p in patterns])
    order = np.argsort(syndromes, kind="stable")
    return low, high, np.array(patterns)[order], np.concatenate([[0], np.cumsum(np.bincount(syndromes, minlength=2048))])


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Message indices of all codewords within 4 bits of each word, the nearest first; and how many each word has (1 or 6)."""
    low, high, patterns, offsets = golay()
    s = low[words & 4095] ^ high[words >> 12]
    counts = offsets[s + 1] - offsets[s]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.repeat(words, counts) ^ patterns[np.repeat(offsets[s], counts) + within]) >> 11, counts


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys. Any two fingerprints within 4 bits share a key.

    Of 64 bits in three segments, 4 errors leave two segments with at most 2 errors together. Words at distance 2
    have a common codeword within 4 of both (that nearest to the word between them); words at distance 1 or 0 have
    the nearest codeword of either within 4 of the other. So the pairs (nearest of one segment, each nearby of the
    other), taken both ways round, meet whether the errors split 2+0, 1+1 or 0+2.
    """
    parts = [nearby(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    firsts = [index[np.cumsum(counts) - counts] for index, counts in parts]
    rows, keys, ids = [], [], np.arange(len(fps))
    for p, (s, t) in enumerate(((0, 1), (0, 2), (1, 2))):
        row = np.repeat(ids, parts[t][1])
        rows.append(row)
        keys.append(p << 24 | firsts[s][row] << 12 | parts[t][0])
        row = np.repeat(ids, parts[s][1])
        key = p << 24 | parts[s][0] << 12 | firsts[t][row]
        again = np.zeros(len(row), bool)
        again[np.cumsum(parts[s][1]) - parts[s][1]] = True  # nearest with nearest, already there
        rows.append(row[~again])
        keys.append(key[~again])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fingerprints of whole texts as signed longs. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows, keys = fuzzy_keys(part.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], ["key", "fp", "comp"])

    return nodes.mapInArrow(run, "key int, fp long, comp long")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most ``bits`` (up to 4) bits.

    docs: doc_id, text; further columns are ignored. Returns (doc_id, fp, component_id), one row for each row of
    ``docs``. Null and empty texts have fingerprint 0 and link like any other; equal texts meet as one fingerprint
    before any join, so groups of copies cost nothing; an empty table gives an empty result.

    Distinct fingerprints are first contracted along links inside one aligned block of ``bits`` bits: fingerprints
    that agree elsewhere are linked for certain and at most 2**bits of them meet. The Golay keys then join
    only fingerprints of different components, so that dense groups don't return all their pairs.
    """
    if not 1 <= bits <= 4:
        raise ValueError("the Golay keys guarantee up to 4 bits")
    spark = docs.sparkSession
    small_batches(spark)
    marked = written(fingerprints(docs, shingle), "simhash-fp")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(63 // bits)), lambda i: F.struct(i.alias("i"), F.col("fp").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit((1 << bits) - 1).cast("long"), i * bits))).alias("rest")))
    meets = nodes.select("fp", F.explode(blocks).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("of")).where("size(of) > 1")
    close = meets.select(F.explode("of").alias("a"), F.array_min("of").alias("b")).where("a <> b")
    first = written(components(close, "simhash-cc"), "simhash-first")
    nodes = written(nodes.join(merged(first), nodes.fp == first.id, "left").select("fp", "least", F.coalesce("root", "fp").alias("comp")), "simhash-nodes")
    rows = keyed(nodes.select("fp", "comp"))
    met = rows.alias("x").join(merged(rows.alias("y")), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits))
    links = met.select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct()
    second = components(links, "simhash-cc")
    found = nodes.join(merged(second), nodes.comp == second.id, "left").select("fp", "least", F.coalesce("root", "comp").alias("comp"))
    found = written(found, "simhash-found")
    least = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(found.join(merged(least), "comp").select("fp", "component_id"), "simhash-named")
    return marked.join(merged(named), "fp", "left").select("doc_id", "fp", "component_id")


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of every run of ``shingle`` words; fewer words are one run, no words none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    prefix = _runs.prefix(_words.of(words))
    return np.unique(_runs.runs(prefix, min(shingle, len(words))))


def needed(n: int, least: float) -> int:
    """Hashes that a set of ``n`` must share with a partner."""
    return math.ceil(n * least - 1e-9)


def partnered(docs: DataFrame, least: float, shingle: int) -> DataFrame:
    """(doc_id): documents that may have a partner, told by three eighths of the hashes: those whose last three bits are below 3, the same ones in all texts.

    Of a set of n hashes a partner lacks n - ceil(``least`` * n) at most, so of these three eighths all but as many occur in another text. Where
    that says nothing, as of short texts, the document stays. One shuffle of these hashes counts them exactly at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, n = [], [], []
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                h = shingles(t, shingle)
                some = h[h & np.uint64(7) < np.uint64(3)]
                asked = len(some) - (len(h) - needed(len(h), least))
                ids.append(i)
                hashes.append(some if asked > 0 else np.array([i], np.int64).view(np.uint64))
                n.append(max(asked, 0))
            if ids:
                many = [len(x) for x in hashes]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(np.repeat(np.array(n, np.int32), many))], ["t", "doc_id", "asked"])

    rows = docs.mapInArrow(run, "t long, doc_id long, asked int").withColumn("n", F.count("*").over(Window.partitionBy("t"))).where("n > 1 or asked = 0")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("asked").alias("asked")).where("n >= asked").select("doc_id")


def similar_documents(docs: DataFrame, least: float = 0.8, shingle: int = 5, most_log2: int = CELLS_LOG2) -> DataFrame:
    """Components of documents whose sets of ``shingle``-word runs have a Jaccard similarity of ``least`` or more: (doc_id, component_id), each doc_id once.

    Complete, unlike fingerprints within a few bits. Two such sets of n and m share at least ``least`` * n hashes. So a
    text of which fewer hashes occur elsewhere, by a count-min sketch that never counts too few, has no partner. Where the texts have more
    hashes than the sketch may have cells, 2**``most_log2``, it would let all of them pass; then it is made of the texts that ``partnered`` leaves.
    For the others, hashes are ordered by ascending count, and the sets of a pair share one of the first n - ceil(least * n) + 1;
    pairs that share one are verified on the whole sets. Equal sets meet as one before that. Rounds that compare one
    member of each component with one hub of each hash contract dense groups, so that the last, full join only pairs
    different components. Texts without words are one group. Rows with null doc_id are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    some, rows = docs, docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    if (rows["size"] or 0) > SPACING << most_log2:
        some, bits = of_ids(docs, partnered(docs, least, shingle), min(max(LEAST_LOG2, (ROOM * rows["n"]).bit_length()), CELLS_LOG2))
        some = written(some, "similar-some")
        bits.destroy()
    pre = prefilter(some, lambda t: shingles(t, shingle), SPACING, wide=False, chunk=400_000, most_log2=most_log2)
    test = pre.test

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, own in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                h = shingles(t, shingle)
                if not len(h) or np.count_nonzero(test(h, own)) >= needed(len(h), least):
                    rows.append((i, xxhash.xxh3_128_digest(h.tobytes()), len(h), h.view(np.int64)))
            if rows:
                ids, keys, n, h = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "key", "n", "h"])

    held = written(pre.docs.mapInArrow(select, "doc_id long, key binary, n int, h array<long>"), "similar-sets")
    pre.close()
    equal = held.groupBy("key").agg(F.min("doc_id").alias("id"))
    equal = written(equal, "similar-equal")
    sets = written(held.join(merged(equal.select("id")), held.doc_id == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "n", "h").where("n > 0").dropDuplicates(["id"]), "similar-distinct")
    tokens = sets.select("id", "n", F.explode("h").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(merged(shared), "t").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))).withColumn("m", F.count("*").over(Window.partitionBy("id")))
    # hashes that no other set has come first in the order and use up the prefix: n - m of them
    prefix = written(ranked.where(F.col("nth") <= F.col("m") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("t", "id", "n"), "similar-prefix")
    comp = sets.select("id", F.col("id").alias("comp"))
    for full in (False, False, True):
        comp = written(comp, "similar-comp")
        of = prefix.join(merged(comp), "id")
        if full:
            met = of.alias("x").join(merged(of.alias("y")), (F.col("x.t") == F.col("y.t")) & (F.col("x.comp") < F.col("y.comp")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least - 1e-9))
            pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        else:
            hub = of.groupBy("t").agg(F.min(F.struct("comp", "id")).alias("hub"))
            pairs = of.join(merged(hub), "t").where("comp <> hub.comp").select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
        a, b = sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), sets.select(F.col("id").alias("b"), F.col("h").alias("hb"))
        both = pairs.distinct().join(merged(a), "a").join(merged(b), "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
        near = both.where(F.col("common") >= (F.size("ha") + F.size("hb") - F.col("common")) * least - 1e-9).select("a", "b")
        ends = near.join(merged(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))), "a").join(merged(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))), "b")
        root = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "similar-cc").select(F.col("id").alias("comp"), "root")
        comp = comp.join(merged(root), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    named = equal.join(merged(comp), "id", "left").select("key", F.coalesce("comp", "id").alias("component_id"))
    found = held.join(merged(named), "key").select("doc_id", "component_id")
    return docs.select("doc_id").distinct().join(merged(found.dropDuplicates(["doc_id"])), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` linked at 4 bits or fewer: (doc_id, fingerprint, component_id), one row for each row; null texts have fingerprint zero."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
