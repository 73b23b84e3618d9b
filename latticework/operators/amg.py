"""Algebraic multigrid over edge tables: adaptive set-up of levels by elimination and aggregation, cycles with a fractional index, preconditioned gradients.

Levels shrink by a factor, so all of them together cost about as much as the first ones. The loop over levels and rounds runs on the driver; all that grows with the graph
is a table. Only a coarsest level of at most ``direct`` nodes, a parameter, is solved as a dense matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import vectors as vec
from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv


def _sums(each, columns: int):
    """An array of sums, one for each test vector."""
    return F.array(*(F.sum(each(c)) for c in range(columns)))


def energy_ratio(d, r, q, y, columns: int):
    """Largest ratio, over the test vectors, of a node's energy with value ``y`` to its least energy, d, r, q being the neighbours' sums of w, w x and w x^2 / 2."""
    least = lambda c: q[c] - r[c] * r[c] / (2 * d)
    ratios = [F.when(least(c) > 1e-30, (d / 2 * y[c] * y[c] - r[c] * y[c] + q[c]) / least(c)).otherwise(F.when(F.abs(y[c] - r[c] / d) <= 1e-15, 1.0).otherwise(float("inf"))) for c in range(columns)]
    return F.greatest(*ratios) if columns > 1 else ratios[0]


@dataclass
class Sweep:
    """State of aggregation: (id, x, cluster or null, seed, round of joining), and how many nodes and joins there are."""

    near: DataFrame
    state: DataFrame
    nodes: int
    joined: int = 0
    rounds: int = 0


def start_sweep(edges: DataFrame, nodes: DataFrame, x: DataFrame, seeds: DataFrame | None = None) -> Sweep:
    """Nothing joined yet; ``seeds`` (id) never join others."""
    vectors = it.stored(x.select("id", "x"), "sweep-x")
    ends = g.both_ways(edges).join(vectors.select(F.col("id").alias("i"), F.col("x").alias("xi")), "i").join(vectors.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j")
    near = it.stored(ends.select("i", "j", F.col("v").alias("w"), vec.affinity(F.col("xi"), F.col("xj")).alias("affinity")).where("affinity is not null"), "sweep-near")
    fixed = seeds.select("id", F.lit(True).alias("seed")) if seeds is not None else nodes.limit(0).select("id", F.lit(True).alias("seed"))
    state = nodes.select("id").join(vectors, "id", "left").join(fixed, "id", "left")
    state = it.stored(state.select("id", "x", F.lit(None).cast("long").alias("cluster"), F.coalesce("seed", F.lit(False)).alias("seed"), F.lit(None).cast("int").alias("round")), "sweep-state")
    return Sweep(near, state, state.count())


def sweep_stage(at: Sweep, columns: int, bins: int = 10, ratio: float = 2.5, guard: float = 0.7 / 1.5) -> Sweep:
    """One stage: free nodes join the seed of largest affinity whose value, put in place of theirs, raises the energy of no test vector above ``ratio`` times the least one.

    Nodes are admitted by equal bins of their largest affinity to a node that hasn't joined, the highest first, empty bins left out. Of the joins that a round finds, those are carried out that
    come before all others in conflict with them (the same node on the other side) by affinity, then by id; joined nodes take their seed's values, and nobody joins a
    node that has joined. Ends after a round that leaves ``guard`` times the nodes as clusters or fewer, or where no join is left. A round is a few joins of the
    edges of admitted nodes with node rows; no node's neighbours meet in one task but in sums.
    """
    open_ = at.state.where("cluster is null").select(F.col("id").alias("j"))
    free = at.state.where("cluster is null and not seed").select(F.col("id").alias("i"))
    best = at.near.join(free, "i", "left_semi").join(open_, "j", "left_semi").groupBy("i").agg(F.max("affinity").alias("best"))
    low, high = best.agg(F.min("best"), F.max("best")).first()
    if low is None:
        return at
    width = (high - low) / bins if high - low > 1e-15 else 1.0
    level = F.least(F.floor((F.col("best") - low) / width), F.lit(bins - 1)).cast("int")
    best = it.stored(best.select("i", (bins - 1 - level).alias("bin")), "sweep-bins")
    order = sorted(r.bin for r in best.select("bin").distinct().collect())  # bins
    state, joined, rounds, admitted = at.state, at.joined, at.rounds, 0
    while at.nodes - joined > guard * at.nodes:
        candidates = best.where(F.col("bin") <= order[admitted]).join(state.where("cluster is null and not seed").select(F.col("id").alias("i")), "i", "left_semi").select("i")
        k = at.near.join(candidates, "i", "left_semi").join(state.select(F.col("id").alias("j"), "x", "cluster"), "j")
        sums = k.groupBy("i").agg(F.sum("w").alias("d"), _sums(lambda c: F.col("w") * F.col("x")[c], columns).alias("r"), _sums(lambda c: F.col("w") * F.col("x")[c] * F.col("x")[c] / 2, columns).alias("q"))
        fit = k.where("cluster is null").join(sums, "i").where(energy_ratio(F.col("d"), F.col("r"), F.col("q"), F.col("x"), columns) <= ratio)
        pick = it.stored(fit.groupBy("i").agg(F.min(F.struct((-F.col("affinity")).alias("rank"), F.col("j").alias("s"))).alias("p")).select("i", "p.s", F.struct("p.rank", "i").alias("place")), "sweep-pick")
        at_seed = pick.select(F.col("i").alias("s"), F.col("place").alias("seed_place"))
        at_node = pick.groupBy(F.col("s").alias("i")).agg(F.min("place").alias("into_place"))
        won = pick.join(at_seed, "s", "left").join(at_node, "i", "left").where((F.col("seed_place").isNull() | (F.col("place") <= F.col("seed_place"))) & (F.col("into_place").isNull() | (F.col("place") <= F.col("into_place"))))
        won = it.stored(won.select("i", "s"), "sweep-won")
        new = won.count()
        rounds += 1
        if new:
            joined += new
            moved = won.select(F.col("i").alias("id"), F.col("s").alias("to")).join(state.select(F.col("id").alias("to"), F.col("x").alias("xs")), "to")
            state = state.join(moved, "id", "left").join(won.select(F.col("s").alias("id"), F.lit(True).alias("now")).distinct(), "id", "left")
            state = it.stored(state.select("id", F.coalesce("xs", "x").alias("x"), F.coalesce("cluster", "to").alias("cluster"), (F.col("seed") | F.coalesce("now", F.lit(False))).alias("seed"), F.when(F.col("to").isNotNull(), F.lit(rounds)).otherwise(F.col("round")).alias("round")), "sweep-state")
        if admitted + 1 < len(order):
            admitted += 1
        elif not new:
            break
    return Sweep(at.near, state, at.nodes, joined, rounds)


def assignment(at: Sweep) -> DataFrame:
    """(id, cluster, round): who joined whom, and in which round; seeds and nodes left alone are their own cluster."""
    return at.state.select("id", F.coalesce("cluster", "id").alias("cluster"), "round")


def aggregate(edges: DataFrame, nodes: DataFrame, x: DataFrame, columns: int, index: float = 1.5, guard: float = 0.7, least: int = 1, most: int = 2, ratio: float = 2.5, hubs: float = 8.0) -> tuple[DataFrame, float, float, int]:
    """((id, cluster, round), alpha, beta, stage) of the best of up to ``most`` stages.

    alpha: clusters by nodes. Stages go on while alpha is ``guard / index`` or more; beta is 1 + alpha above that limit (too much work for the cycle) and 1 - alpha below it
    (a small level is a rough one), and the stage of least beta is taken. Nodes with ``hubs`` times their neighbours' mean degree or more are seeds.
    """
    degree = g.degrees(edges).select("id", "degree")
    a = g.both_ways(edges).join(degree.select(F.col("id").alias("j"), F.col("degree").alias("dj")), "j").groupBy(F.col("i").alias("id")).agg((F.sum(F.abs("v") * F.col("dj")) / F.sum(F.abs("v"))).alias("mean"))
    seeds = degree.join(a, "id").where(F.col("degree") >= hubs * F.col("mean")).select("id")
    at, limit, found = start_sweep(edges, nodes, x, seeds), guard / index, []
    for stage in range(1, most + 1):
        if stage > least and (at.nodes - at.joined) < at.nodes * limit:
            break
        before, at = at.joined, sweep_stage(at, columns, ratio=ratio, guard=limit)
        alpha = (at.nodes - at.joined) / max(at.nodes, 1)
        found.append((1 + alpha if alpha > limit else 1 - alpha, stage, alpha, at))
        if at.joined == before:
            break
    beta, stage, alpha, at = min(found, key=lambda f: f[:2])
    return assignment(at), alpha, beta, stage


def filter_rate(edges: DataFrame, nodes: DataFrame, level: int, power: int = 2, damping: float = 0.1) -> tuple[float, DataFrame]:
    """How fast the smooth filter takes a random vector down at this level, and (id, x) of that vector after ``power`` steps.

    The rate is that of ``power`` further steps, without means, as the root of 4 + 2 (level - 1) sweeps.
    """
    smooth = it.stored(g.smooth_filter(edges, nodes, damping), "filter")
    x = nodes.select("id", (2 * g.uniform(F.col("id"), 40 + level) - 1).alias("x"))
    for _ in range(power):
        x = it.stored(g.times_vector(smooth, x), "filtered")
    y = x
    for _ in range(power):
        y = it.stored(g.times_vector(smooth, y), "filtered")
    before, after = (v.agg(F.stddev_pop("x")).first()[0] or 0.0 for v in (x, y))
    return (after / before if before else 0.0) ** (1 / (4 + 2 * (level - 1))), x


@dataclass
class Level:
    """A level's graph, how it came about, and how it hangs on the finer one: clusters, or eliminated nodes stage by stage."""

    kind: str
    edges: DataFrame
    nodes: DataFrame
    size: int
    links: int
    rate: float | None = None
    alpha: float | None = None
    beta: float | None = None
    stage: int | None = None
    assign: DataFrame | None = None
    steps: list[tuple[DataFrame, DataFrame, DataFrame]] = field(default_factory=list)


def _level(kind: str, edges: DataFrame, nodes: DataFrame, **more) -> Level:
    edges, nodes = it.stored(edges, "level-edges"), it.stored(nodes, "level-nodes")
    return Level(kind, edges, nodes, nodes.count(), edges.count(), **more)


def eliminate(edges: DataFrame, nodes: DataFrame, size: int, degree: int = 4, share: float = 0.01, direct: int = 200, most: int = 1000) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame, DataFrame]]]:
    """(edges, nodes, stages) after independent sets of nodes of ``degree`` or less are taken out, again and again.

    Ends where a set holds ``share`` of the nodes or less, or no node would be left, or ``direct`` nodes are left. A stage is (rows (i, j, v) of -A_ff^-1 A_fc, (id, q) with 1 / a_ff, the nodes left).
    """
    stages = []
    while len(stages) < most and size > direct:
        gone = it.stored(it.independent_set(edges, nodes, degree), "gone")
        n = gone.count()
        if n <= share * size or n == size:
            break
        rows, q = (it.stored(t, "elimination") for t in lv.elimination(edges, gone))
        left = it.stored(nodes.join(gone, "id", "left_anti").select("id"), "left")
        edges = it.stored(g.adjacency(lv.schur_complement(edges, gone)), "schur")
        nodes, size = left, size - n
        stages.append((rows, gone.join(q, "id", "left").select("id", F.coalesce("q", F.lit(0.0)).alias("q")), left))
    return edges, nodes, stages


def setup(edges: DataFrame, nodes: DataFrame, elimination: bool = False, direct: int = 200, fast: float = 0.3, vectors: int = 4, more: int = 1, most_vectors: int = 10, index: float = 1.5, most: int = 100) -> list[Level]:
    """Levels from the finest on: finest, then elimination and aggregation in turn until done.

    Done where the graph has fewer than ``direct`` nodes or no edges, the smooth filter takes random vectors down at rate ``fast`` or faster, aggregation joins nothing, or there are ``most``
    levels. Each aggregation has its own test vectors, one of them that of the rate's test, ``more`` of them at each coarser level. Nodes and clusters without
    edges, components that are one node by now, have nothing left to solve and don't go on to the next level.
    """
    levels, state, columns = [_level("finest", edges, nodes)], "elimination" if elimination else "aggregation", vectors
    while state != "done" and len(levels) < most:
        at = levels[-1]
        if at.size < direct or not at.links:
            break
        if state == "elimination":
            e, n, stages = eliminate(at.edges, at.nodes, at.size, direct=direct)
            if stages:
                levels.append(_level("elimination", e, n, steps=stages))
            state = "aggregation"
            continue
        live = it.stored(g.degrees(at.edges).select("id"), "live")
        at.rate, slow = filter_rate(at.edges, live, len(levels))
        if at.rate <= fast:
            break
        random = lv.test_vectors(at.edges, live, columns - 1) if columns > 1 else live.select("id", F.array().cast("array<double>").alias("x"))
        x = slow.join(random.withColumnRenamed("x", "others"), "id").select("id", F.concat(F.array("x"), "others").alias("x"))
        assign, alpha, beta, stage = aggregate(at.edges, live, it.stored(x, "test-vectors"), columns, index)
        if alpha == 1:
            break
        assign = it.stored(assign, "aggregates")
        coarse = it.stored(lv.coarse_edges(at.edges, assign), "level-edges")
        levels.append(_level("aggregation", coarse, g.degrees(coarse).select("id"), assign=assign, alpha=alpha, beta=beta, stage=stage))
        columns, state = min(most_vectors, columns + more), "elimination" if elimination else "aggregation"
    return levels


def complexities(levels: list[Level], index: float = 1.5) -> tuple[float, float, float]:
    """Nodes and edges of all levels by the finest's, and the edges' work when each aggregation level is visited ``index`` times as often as the one above."""
    first, times, work = levels[0], 1.0, 0.0
    for k, at in enumerate(levels):
        times *= index if at.kind == "aggregation" and k + 1 < len(levels) else 1.0
        work += times * at.links
    return sum(x.size for x in levels) / max(first.size, 1), sum(x.links for x in levels) / max(first.links, 1), work / max(first.links, 1)


def visits(depth: int, index: float) -> list[int]:
    """The levels of one cycle in order: below the finest, level l goes down again while it has done so fewer than ``index`` times as often as the level above it."""
    if depth == 1:
        return [0]
    down, at, path = [0] * (depth - 1), 0, [0]
    while True:
        if at == depth - 1:
            at -= 1
        elif down[at] < (1 if at == 0 else index * down[at - 1]):
            down[at] += 1
            at += 1
        elif at == 0:
            return path
        else:
            at -= 1
        path.append(at)


class Solver:
    """Cycles over levels of ``setup``. (id, x) vectors; right-hand sides must sum to zero over each component."""

    def __init__(self, levels: list[Level], index: float = 1.5, before: int = 1, after: int = 2, damping: float = 2 / 3, direct: int = 2000):
        """``before`` and ``after``: damped Jacobi sweeps; a coarsest level of more than ``direct`` nodes is solved by conjugate gradients, a smaller one as a dense matrix."""
        self.levels, self.index, self.before, self.after, self.damping = levels, index, before, after, damping
        self.matrix = [it.stored(g.laplacian(x.edges), "matrix") for x in levels]
        last = levels[-1]
        self.dense = None
        if last.size <= direct:
            self.ids = [r.id for r in last.nodes.orderBy("id").collect()]  # ``direct`` rows at most
            place = {i: k for k, i in enumerate(self.ids)}
            w = np.zeros((len(self.ids),) * 2)
            for r in last.edges.collect():
                w[place[r.i], place[r.j]] = w[place[r.j], place[r.i]] = r.w
            self.place, self.dense = place, np.linalg.pinv(np.diag(w.sum(1)) - w, hermitian=True) if len(w) else w

    def relaxed(self, at: int, x: DataFrame, b: DataFrame, sweeps: int) -> DataFrame:
        for _ in range(sweeps):
            x = it.stored(g.jacobi_step(self.levels[at].edges, x, b, self.damping).select("id", "x"), "relaxed")
        return x

    def residual(self, at: int, x: DataFrame, b: DataFrame) -> DataFrame:
        ax = g.times_vector(self.matrix[at], x).withColumnRenamed("x", "ax")
        return it.stored(b.join(ax, "id", "left").select("id", (F.col("x") - F.coalesce("ax", F.lit(0.0))).alias("x")), "residual")

    def coarsest(self, b: DataFrame) -> DataFrame:
        if not self.levels[-1].links:
            return b.select("id", F.lit(0.0).alias("x"))
        if self.dense is None:
            return it.stored(it.conjugate_gradients(self.matrix[-1], b, tolerance=1e-10), "coarsest")
        given = np.zeros(len(self.ids))
        for r in b.collect():  # ``direct`` rows at most
            given[self.place[r.id]] = r.x
        return b.sparkSession.createDataFrame([(i, float(v)) for i, v in zip(self.ids, self.dense @ given)], "id long, x double")

    def combined(self, x: DataFrame, r: DataFrame, others: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        """x plus the mix of its differences to earlier iterates that leaves the least residual; only the mix's normal equations reach the driver."""
        both = r.join(x.withColumnRenamed("x", "y"), "id").withColumnRenamed("x", "r")
        for k, (xk, rk) in enumerate(others):
            both = both.join(xk.select("id", F.col("x").alias(f"x{k}")), "id").join(rk.select("id", F.col("x").alias(f"r{k}")), "id")
        both = it.stored(both, "iterates")
        n = len(others)
        e = [F.col("r") - F.col(f"r{k}") for k in range(n)]
        row = both.agg(*(F.sum(e[p] * e[q]) for p in range(n) for q in range(n)), *(F.sum(e[p] * F.col("r")) for p in range(n))).first()
        gram, right = np.array([v or 0.0 for v in row[: n * n]]).reshape(n, n), np.array([v or 0.0 for v in row[n * n :]])
        mix = np.linalg.lstsq(gram, right, rcond=1e-12)[0]
        change = sum((float(a) * (F.col(f"x{k}") - F.col("y")) for k, a in enumerate(mix)), F.lit(0.0))
        return it.stored(both.select("id", (F.col("y") + change).alias("x")), "combined")

    def cycle(self, b: DataFrame, x: DataFrame | None = None) -> DataFrame:
        """(id, x) after one cycle on L x = b, from zero where ``x`` isn't given.

        Down an aggregation, the residual is summed over clusters and corrections come back as they are; down an elimination the system itself is reduced, and its
        solution gives that of the eliminated nodes. Below the finest level, what a revisit adds is combined with the iterates before it by least residual.
        """
        path = visits(len(self.levels), self.index)
        zero = lambda v: v.select("id", F.lit(0.0).alias("x"))
        xs, bs = {0: zero(b) if x is None else x}, {0: it.stored(b.select("id", "x"), "rhs")}
        held: dict[int, list[tuple[DataFrame, DataFrame]]] = {}
        sides: dict[int, list[DataFrame]] = {}
        last = len(self.levels) - 1
        if not last:
            return self.coarsest(b)
        for here, there in zip(path, path[1:]):
            below = self.levels[max(here, there)]
            if there > here:
                xs[here] = self.relaxed(here, xs[here], bs[here], self.before) if below.kind == "aggregation" else xs[here]
                held[there] = []
                if below.kind == "aggregation":
                    r = self.residual(here, xs[here], bs[here])
                    bs[there] = it.stored(r.join(below.assign, "id").groupBy(F.col("cluster").alias("id")).agg(F.sum("x").alias("x")).join(below.nodes, "id", "left_semi"), "rhs")
                else:
                    bs[there], sides[there] = self.reduced(bs[here], below)
                xs[there] = zero(bs[there])
                if here and below.kind == "aggregation":
                    held[here].append((xs[here], r))
            else:
                if here == last:
                    xs[here] = self.coarsest(bs[here])
                elif held[here] and self.levels[here + 1].kind == "aggregation":
                    xs[here] = self.combined(xs[here], self.residual(here, xs[here], bs[here]), held[here][-2:])
                if below.kind == "aggregation":
                    step = below.assign.join(xs[here].select(F.col("id").alias("cluster"), F.col("x").alias("e")), "cluster").select("id", "e")
                    xs[there] = it.stored(xs[there].join(step, "id", "left").select("id", (F.col("x") + F.coalesce("e", F.lit(0.0))).alias("x")), "corrected")
                    xs[there] = self.relaxed(there, xs[there], bs[there], self.after)
                else:
                    xs[there] = self.filled(xs[here], sides[here], below)
        return xs[0]

    @staticmethod
    def reduced(b: DataFrame, below: Level) -> tuple[DataFrame, list[DataFrame]]:
        """b_c + P' b_f of each stage in turn, and the right-hand sides of the stages."""
        sides = []
        for rows, _, left in below.steps:
            sides.append(b)
            moved = rows.join(b.select(F.col("id").alias("i"), "x"), "i").select(F.col("j").alias("id"), (F.col("v") * F.col("x")).alias("x"))
            b = it.stored(b.join(left, "id", "left_semi").unionByName(moved).groupBy("id").agg(F.sum("x").alias("x")), "reduced")
        return b, sides

    @staticmethod
    def filled(x: DataFrame, sides: list[DataFrame], below: Level) -> DataFrame:
        """x_f = P x_c + q b_f, from the last stage back."""
        for (rows, q, _), b in zip(reversed(below.steps), reversed(sides)):
            own = q.join(b, "id").select("id", (F.col("q") * F.col("x")).alias("x"))
            near = rows.join(x.select(F.col("id").alias("j"), "x"), "j").select(F.col("i").alias("id"), (F.col("v") * F.col("x")).alias("x"))
            x = it.stored(x.unionByName(own.unionByName(near).groupBy("id").agg(F.sum("x").alias("x"))), "filled")
        return x

    def solve(self, b: DataFrame, tolerance: float = 1e-10, steps: int = 60) -> tuple[DataFrame, list[float]]:
        """(id, x) by conjugate gradients with the cycle as preconditioner, and the relative residual after each step; an error where ``steps`` don't reach ``tolerance``.

        As the cycle combines iterates it isn't the same matrix each time, so directions take the change of residuals into account (flexible gradients).
        """
        matrix = self.matrix[0]
        state = it.stored(b.select("id", F.lit(0.0).alias("x"), F.col("x").alias("r")), "solve")
        first = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        history: list[float] = []
        while first and (not history or history[-1] > tolerance):
            if len(history) == steps:
                raise ArithmeticError(f"relative residual {history[-1]:.1e} after {steps} steps, above {tolerance:.1e}")
            z = self.cycle(state.select("id", F.col("r").alias("x"))).withColumnRenamed("x", "z")
            state = it.stored(state.join(z, "id", "left").withColumn("z", F.coalesce("z", F.lit(0.0))), "solve")
            rz, again = state.agg(F.sum(F.col("r") * F.col("z")), F.sum((F.col("r") - F.col("old")) * F.col("z")) if "old" in state.columns else F.lit(0.0)).first()
            direction = F.col("z") + again / before * F.col("p") if history else F.col("z")
            state = state.withColumn("p", direction)
            q = g.times_vector(matrix, state.select("id", F.col("p").alias("x"))).withColumnRenamed("x", "q")
            state = it.stored(state.join(q, "id", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "solve")
            alpha = rz / state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
            before = rz
            state = it.stored(state.select("id", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), F.col("r").alias("old"), "p"), "solve")
            history.append(((state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0) / first) ** 0.5)
        return state.select("id", "x"), history
