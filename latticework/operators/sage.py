"""Unsupervised training of a two-layer neighbourhood model: Spark samples, joins and sums gradients, the driver holds the weights alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators.spectra import ROWS, _lists, _rows, mapped, summed

NAMES = ("own1", "near1", "own2", "near2")


def support(edges: DataFrame, x: DataFrame, near: int = 10, wide: int = 25) -> DataFrame:
    """(id, s): what both layers read of a node, as one flat array: its features and the mean over ``wide`` sampled neighbours, then the same of ``near`` sampled neighbours.

    Nodes without neighbours stand in for them. So a row has 2 (near + 1) times the number of features, whatever the degree; no group holds more than ``wide`` vectors.
    """
    far = g.sampled_neighbours(edges, wide).join(x.select(F.col("id").alias("neighbour"), F.col("x").alias("n")), "neighbour")
    many = F.collect_list("n")  # at most ``wide``
    mean = far.groupBy("id").agg(F.transform(F.aggregate(F.slice(many, 2, wide), many[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q)), lambda t: t / F.count("*")).alias("m"))
    inputs = it.stored(x.join(mean, "id", "left").select("id", F.concat("x", F.coalesce("m", "x")).alias("s")), "sage-inputs")
    close = g.sampled_neighbours(edges, near).join(inputs.select(F.col("id").alias("neighbour"), F.col("s").alias("n")), "neighbour")
    around = close.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "n"))), lambda t: t["n"])).alias("n"))
    return inputs.join(around, "id", "left").select("id", F.concat("s", F.coalesce("n", F.flatten(F.array_repeat("s", near)))).alias("s"))


def start(features: int, size: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights drawn evenly within +-sqrt(6 / (rows + columns))."""
    rng = np.random.default_rng(seed)
    shapes = {"own1": (features, size), "near1": (features, size), "own2": (2 * size, size), "near2": (2 * size, size)}
    return {k: rng.uniform(-1, 1, shape) * np.sqrt(6 / sum(shape)) for k, shape in shapes.items()}


def forward(w: dict[str, np.ndarray], s: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Unit vectors of support rows, and what the way back needs. Both layers set own and mean parts side by side; the first is rectified."""
    s = s.reshape(len(s), -1, 2, len(w["own1"]))
    hidden = np.maximum(np.concatenate([s[:, :, 0] @ w["own1"], s[:, :, 1] @ w["near1"]], axis=2), 0)
    own, mean = hidden[:, 0], hidden[:, 1:].mean(axis=1)
    out = np.concatenate([own @ w["own2"], mean @ w["near2"]], axis=1)
    length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)
    return out / length, (s, hidden, mean, length)


def backward(w: dict[str, np.ndarray], z: np.ndarray, held: tuple, dz: np.ndarray) -> np.ndarray:
    """Gradient by the weights, as one flat array, for the gradient ``dz`` by the unit vectors."""
    s, hidden, mean, length = held
    size = w["own1"].shape[1]
    out = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / length
    below = np.empty_like(hidden)
    below[:, 0] = out[:, :size] @ w["own2"].T
    below[:, 1:] = (out[:, size:] @ w["near2"].T)[:, None] / (hidden.shape[1] - 1)
    below *= hidden > 0
    first = [s[:, :, side].reshape(-1, s.shape[3]).T @ below[:, :, side * size : (side + 1) * size].reshape(-1, size) for side in (0, 1)]
    return np.concatenate([x.ravel() for x in (*first, hidden[:, 0].T @ out[:, :size], mean.T @ out[:, size:])])


def loss_and_gradient(w: dict[str, np.ndarray], u: np.ndarray, v: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Summed over pairs: the logistic loss of true pairs and of each first node with all ``others``, the same for all pairs; the first entry is the loss."""
    (zu, hu), (zv, hv), (zo, ho) = forward(w, u), forward(w, v), forward(w, others)
    true, false = (zu * zv).sum(axis=1, keepdims=True), zu @ zo.T
    by_true, by_false = -1 / (1 + np.exp(true)), 1 / (1 + np.exp(-false))
    loss = np.logaddexp(0, -true).sum() + np.logaddexp(0, false).sum()
    gradient = backward(w, zu, hu, by_true * zv + by_false @ zo) + backward(w, zv, hv, by_true * zu) + backward(w, zo, ho, by_false.T @ zu)
    return np.concatenate([[loss], gradient])


@dataclass
class Adam:
    """Moment estimates of flat gradients, whose entries are cut to +-5 first."""

    rate: float = 0.01
    step: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0
    losses: list[float] = field(default_factory=list)

    def moved(self, w: dict[str, np.ndarray], gradient: np.ndarray) -> dict[str, np.ndarray]:
        gradient = np.clip(gradient, -5, 5)
        self.step += 1
        self.mean, self.square = 0.9 * self.mean + 0.1 * gradient, 0.999 * self.square + 0.001 * gradient**2
        change = self.rate * (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.999**self.step)) + 1e-8)
        cuts = np.cumsum([w[k].size for k in NAMES])[:-1]
        return {k: w[k] - c.reshape(w[k].shape) for k, c in zip(NAMES, np.split(change, cuts))}


def negatives(weights: DataFrame, step: int, many: int) -> DataFrame:
    """(id): ``many`` nodes of (id, degree), drawn without repeats in proportion to degree^0.75: the least -ln(u) / weight, u hashed from node and step."""
    key = -F.log(1 - g.uniform(F.col("id"), F.lit(step).cast("long") + 100)) / F.pow("degree", F.lit(0.75))
    return weights.orderBy(key, "id").limit(many).select("id")


def pulls(own: np.ndarray, other: np.ndarray, about: np.ndarray) -> np.ndarray:
    """For each pair seen from one of its ends: the gradient of its true term by that end's unit vector, then its loss and its number of pairs if that end is the first.

    about: how often the pair occurs, and whether this end is the first (0 or 1).
    """
    true, (many, first) = (own * other).sum(axis=1), about.T
    return np.column_stack([(-many / (1 + np.exp(true)))[:, None] * other, first * many * np.logaddexp(0, -true), first * many])


def node_gradient(w: dict[str, np.ndarray], s: np.ndarray, pull: np.ndarray, others: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Pairs, loss, gradient by the weights and, for the way back of ``others`` (unit vectors), that by them; from nodes' support rows and the sums of their ``pulls``."""
    total = 0.0
    for at in range(0, len(s), rows):
        z, held = forward(w, s[at : at + rows])
        pulled, loss, many = np.split(pull[at : at + rows], [z.shape[1], z.shape[1] + 1], axis=1)
        false = z @ others.T
        by_false = many / (1 + np.exp(-false))
        losses = loss.sum() + (many * np.logaddexp(0, false)).sum()
        total = total + np.concatenate([[many.sum(), losses], backward(w, z, held, pulled + by_false @ others), (by_false.T @ z).ravel()])
    return total


def pulled(ends: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, q): sums of ``pulls`` for each node of (a, b, many, first), both of whose nodes have unit vectors (id, q). A node may have several rows, one for each batch of a task at most."""
    own, other = vectors.select(F.col("id").alias("a"), F.col("q").alias("za")), vectors.select(F.col("id").alias("b"), F.col("q").alias("zb"))
    met = ends.join(other.hint("shuffle_hash"), "b").join(own.hint("shuffle_hash"), "a").select("a", "za", "zb", F.array("many", "first").alias("about"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
                out = np.zeros((len(ids), width + 2))
                np.add.at(out, at, pulls(*(_rows(b.column(k)) for k in (1, 2, 3))))
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(out)], ["id", "q"])

    return met.mapInArrow(run, ROWS)


def train(pairs: DataFrame, edges: DataFrame, rows: DataFrame, features: int, size: int = 32, batches: int = 8, passes: int = 2, many: int = 20, rate: float = 0.01, w: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights, and the mean loss of each step, from (id, context) pairs and ``support`` rows.

    Pairs lie in a table parted by batch, as bare ids with their number, seen from either end. A step turns each support row into a unit vector, joins these with its pairs, sums
    what pairs pull at each node, and goes back through each node's row once, however many pairs it has; support rows are never joined with pairs nor shuffled, as they stay dealt by node.
    Gradients are summed in the cluster (as many numbers a task as there are weights); ``many`` negative rows and the weights travel with the tasks, none of which grows with the data.
    Batches are hashed: lost tasks see the same pairs.
    """
    spark = pairs.sparkSession
    batch = F.pmod(F.xxhash64("id", "context"), F.lit(batches)).cast("int")
    counted = pairs.groupBy("id", "context").agg(F.count("*").cast("double").alias("many")).withColumn("batch", batch)
    ends = F.explode(F.array(F.struct(F.col("id").alias("a"), F.col("context").alias("b"), F.lit(1.0).alias("first")), F.struct(F.col("context").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("first"))))
    path = it.scratch(spark, "sage-pairs")
    counted.select("many", "batch", ends.alias("e")).select("e.*", "many", "batch").repartition("batch", F.pmod("a", F.lit(16))).write.partitionBy("batch").parquet(path)
    table = spark.read.schema("a long, b long, first double, many double, batch int").parquet(path)
    degrees = it.checkpointed(g.degrees(edges).select("id", "degree"))
    drawn = None
    for step in range(passes * batches):
        part = negatives(degrees, step, many).withColumn("step", F.lit(step))
        drawn = part if drawn is None else drawn.unionAll(part)
    negative = {}
    for r in it.checkpointed(drawn).join(rows, "id").orderBy("step", "id").collect():  # ``many`` rows for each step
        negative.setdefault(r.step, []).append(r.s)
    w, adam = w or start(features, size), Adam(rate)
    width, weights = 2 * size, sum(x.size for x in w.values())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 5_000))
    dealt = rows.select("id", "s").repartition(n, "id").persist()
    for step in range(passes * batches):
        if step not in negative:  # no edges
            continue
        now = table.where(F.col("batch") == step % batches)
        others, held = forward(w, np.array(negative[step]))
        z = it.stored(mapped(dealt, lambda s, w=w: np.concatenate([forward(w, s[at : at + 1024])[0] for at in range(0, len(s), 1024)])), "sage-vectors")
        pull = pulled(now, z, width).withColumnRenamed("q", "pull").hint("shuffle_hash")
        total = summed(dealt.join(pull, "id").select("id", "s", "pull"), (2 + weights + others.size, 1), lambda s, pull, w=w, others=others: node_gradient(w, s, pull, others)[:, None]).ravel()
        pairs_, loss, gradient, by_others = total[0], total[1], total[2 : 2 + weights], total[2 + weights :].reshape(others.shape)
        if not pairs_:
            continue
        adam.losses.append(loss / pairs_)
        w = adam.moved(w, (gradient + backward(w, others, held, by_others)) / pairs_)
    dealt.unpersist()
    return w, adam.losses


def embedded(rows: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(id, x): the unit vectors of all nodes."""
    return mapped(rows.select("id", "s"), lambda s: forward(w, s)[0]).select("id", F.col("q").alias("x"))


def reciprocal_ranks(z: DataFrame, pairs: DataFrame, others: DataFrame) -> DataFrame:
    """(id, context, rank, reciprocal): the place of each pair's inner product among those of its first node with all ``others`` (id), a bounded set; ties before it don't count."""
    far = np.array([r.x for r in others.join(z, "id").select("x").collect()])  # the bounded set
    both = pairs.join(z.withColumnRenamed("x", "u"), "id").join(z.select(F.col("id").alias("context"), F.col("x").alias("v")), "context").select("id", "context", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v = _rows(b.column(2)), _rows(b.column(3))
                true, all_ = np.zeros(len(u)), np.zeros((len(u), len(far)))
                for c in range(u.shape[1] if len(far) else 0):  # in one order, so that equal vectors tie
                    true += u[:, c] * v[:, c]
                    all_ += u[:, c, None] * far[:, c]
                rank = 1 + (all_ > true[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rank, pa.int32()), pa.array(1 / rank)], ["id", "context", "rank", "reciprocal"])

    return both.mapInArrow(run, "id long, context long, rank int, reciprocal double")
