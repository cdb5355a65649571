"""Seeded graphs, structural equations and event cascades as DataFrames.

Noise of row i for variable j depends on the seed, i and j alone, so any number of
partitions gives the same table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.columns import sigmoid
from causeway.operators.graph import k_hop_ring
from causeway.plans.dense import order_of
from causeway.sources.files import datasets

# --- graphs ----------------------------------------------------------------


def _weights(b: np.ndarray, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    return b * rng.uniform(low, high, b.shape) * rng.choice([-1, 1], b.shape)


def _directed(undirected: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    p = rng.permutation(len(undirected))
    return np.tril(undirected, -1)[np.ix_(p, p)]


def random_dag(kind: str, d: int, edges: int, seed: int = 0, weights: tuple[float, float] = (0.5, 2.0), split: float = 0.2, levels: int = 5, rank: int = 3) -> np.ndarray:
    """Weighted DAG with about `edges` edges: erdos_renyi, scale_free, bipartite, hierarchical or low_rank."""
    rng = np.random.default_rng(seed)
    if kind == "erdos_renyi":
        g = (rng.random((d, d)) < min(1.0, edges / max(d * (d - 1) / 2, 1))).astype(int)
    elif kind == "scale_free":
        m, g = max(1, round(edges / d)), np.zeros((d, d), dtype=int)
        for v in range(1, d):
            chance = g[:v].sum(axis=1) + g[:, :v].sum(axis=0) + 1.0
            g[v, rng.choice(v, min(m, v), replace=False, p=chance / chance.sum())] = 1
    elif kind == "bipartite":
        top = max(1, int(split * d))
        g = np.zeros((d, d), dtype=int)
        g[top:, :top] = rng.random((d - top, top)) < edges / max(top * (d - top), 1)
    elif kind == "hierarchical":
        level, g = np.sort(rng.integers(0, levels, d)), np.zeros((d, d), dtype=int)
        near = level[:, None] - level[None, :] == 1
        g[near] = rng.random(int(near.sum())) < edges / max(int(near.sum()), 1)
    elif kind == "low_rank":
        order, g = rng.permutation(d), np.zeros((d, d), dtype=int)
        hubs = order[rng.choice(d, min(rank, d), replace=False)]
        place = np.argsort(order)
        for _ in range(20 * edges):
            if g.sum() >= edges:
                break
            a, b = rng.choice(hubs), rng.integers(d)
            if place[a] != place[b]:
                g[(a, b) if place[a] < place[b] else (b, a)] = 1
        return _weights(g, *weights, rng)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return _weights(_directed(g, rng), *weights, rng)


def random_topology(n: int, edges: int, seed: int = 0) -> np.ndarray:
    """Undirected 0/1 matrix with exactly `edges` edges, as far as there are pairs."""
    rng, g = np.random.default_rng(seed), np.zeros((n, n), dtype=int)
    i, j = np.triu_indices(n, 1)
    pick = rng.choice(len(i), min(edges, len(i)), replace=False)
    g[i[pick], j[pick]] = g[j[pick], i[pick]] = 1
    return g


def edges_of(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in np.argwhere(matrix)], "src int, dst int, weight double")


# --- structural equations ----------------------------------------------------


def _uniform(seed: int, *keys) -> Column:
    """In (0, 1), from a hash of the keys."""
    h = F.xxhash64(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def noise(kind: str, scale: float, seed: int, *keys) -> Column:
    u, v = _uniform(seed, *keys), _uniform(seed + 7919, *keys)
    if kind in ("gauss", "normal"):
        return scale * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    if kind == "exp":
        return -scale * F.log(u)
    if kind == "gumbel":
        return -scale * F.log(-F.log(u))
    if kind == "uniform":
        return scale * (2 * u - 1)
    raise ValueError(f"unknown noise {kind!r}")


def sample(spark: SparkSession, w: np.ndarray, n: int, method: str = "linear", sem: str = "gauss", scale: float = 1.0, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows (row, x0 .. x{d-1}) of a structural model on the weighted DAG w.

    linear: sem is gauss, exp, gumbel, uniform or logistic. nonlinear: sem is mlp
    (a random hidden layer), mim (tanh, cos and sin of three indexes) or gp (random
    Fourier features of a Gaussian process), gp-add (one process a parent).
    quadratic: averaged squares and products of the parents.
    """
    order = order_of(w != 0)
    if order is None:
        raise ValueError("the graph has a cycle")
    rng, row = np.random.default_rng(seed), F.col("row")
    df = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "row")
    for j in order:
        parents = np.flatnonzero(w[:, j]).tolist()
        xs = [F.col(f"x{i}") for i in parents]
        z = noise(sem if method == "linear" and sem != "logistic" else "gauss", scale, seed, row, j)
        if method == "linear":
            mean = sum((float(w[i, j]) * F.col(f"x{i}") for i in parents), F.lit(0.0))
            value = (_uniform(seed, row, j) < sigmoid(mean)).cast("double") if sem == "logistic" else mean + z
        elif method == "quadratic":
            terms = [float(c) * a * b for k, a in enumerate(xs) for b in xs[k:] for c in [rng.uniform(0.5, 1) * rng.choice([-1, 1])]]
            terms += [float(c) * a for a in xs for c in [rng.uniform(0.5, 1) * rng.choice([-1, 1])]]
            value = sum(terms, F.lit(0.0)) / max(1, len(terms)) + z
        elif method == "nonlinear":
            value = _curve(sem, xs, rng) + z
        else:
            raise ValueError(f"unknown method {method!r}")
        df = df.withColumn(f"x{j}", value)
    return df.select("row", *[f"x{j}" for j in range(len(w))])


def _curve(sem: str, xs: list[Column], rng: np.random.Generator) -> Column:
    if not xs:
        return F.lit(0.0)
    index = lambda low, high: sum((float(c) * x for x, c in zip(xs, rng.uniform(low, high, len(xs)) * rng.choice([-1, 1], len(xs)), strict=True)), F.lit(0.0))
    if sem == "mim":
        return F.tanh(index(0.5, 2)) + F.cos(index(0.5, 2)) + F.sin(index(0.5, 2))
    if sem == "mlp":
        return sum((float(rng.uniform(0.5, 2) * rng.choice([-1, 1])) * sigmoid(index(0.5, 2)) for _ in range(20)), F.lit(0.0))
    if sem in ("gp", "gp-add"):
        groups = [xs] if sem == "gp" else [[x] for x in xs]
        waves = []
        for g in groups:
            for _ in range(30):
                inner = sum((float(c) * x for x, c in zip(g, rng.normal(0, 1, len(g)), strict=True)), F.lit(float(rng.uniform(0, 2 * np.pi))))
                waves.append(float(rng.normal(0, (2 / 30) ** 0.5)) * F.cos(inner))
        return sum(waves, F.lit(0.0))
    raise ValueError(f"unknown sem {sem!r}")


# --- event cascades ------------------------------------------------------------


def cascade(spark: SparkSession, alpha: np.ndarray, mu: np.ndarray, topology: np.ndarray, span: float, max_hop: int = 1, beta: float = 10.0, seed: int = 0, most_generations: int = 50) -> DataFrame:
    """Event log (event string, timestamp double, node int) of a Hawkes process on a topology.

    First generation: each event type at each node at rate mu. Then each event
    raises type j's rate by alpha[i, j] at nodes exactly k hops away, at delays of
    mean 1 / beta, generation by generation until one is empty. alpha may carry a
    leading axis of hops 0 .. max_hop.
    """
    alpha = np.broadcast_to(alpha, (max_hop + 1, *alpha.shape[-2:]))
    d, n = alpha.shape[1], len(topology)
    cells = spark.range(d * n).select((F.col("id") % d).cast("int").alias("e"), (F.col("id") / d).cast("int").alias("node"))
    rates = F.create_map(*[x for i in range(d) for x in (F.lit(i), F.lit(float(mu[i])))])
    number = lambda mean, *keys: _poisson(mean, seed, *keys)
    first = cells.withColumn("k", number(rates[F.col("e")] * span, F.lit(0), F.col("e"), F.col("node"))).filter("k > 0")
    first = first.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumn("id", F.xxhash64(F.lit(seed), "e", "node", "i"))
    generation = first.select("id", "e", "node", (_uniform(seed, F.col("id")) * span).alias("t"))
    ring = k_hop_ring(edges_of(spark, topology).select("src", "dst"), max_hop).union(spark.range(n).select(F.col("id").cast("int"), F.lit(0), F.col("id").cast("int"))).distinct()
    effects = spark.createDataFrame([(k, i, j, float(alpha[k, i, j])) for k, i, j in np.argwhere(alpha > 0).tolist()], "hop int, e int, to int, a double")
    from causeway.operators.graph import _local

    every = generation = _local(generation)
    for g in range(1, most_generations + 1):
        children = generation.join(F.broadcast(effects), "e").join(ring, ["node", "hop"])
        children = children.withColumn("k", number(F.col("a"), F.lit(g), F.col("id"), F.col("to"), F.col("neighbour"))).filter("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
        children = children.withColumn("id", F.xxhash64("id", "to", "neighbour", "i"))
        generation = _local(children.select("id", F.col("to").alias("e"), F.col("neighbour").alias("node"), (F.col("t") - F.log(_uniform(seed, F.col("id"))) / beta).alias("t")).filter(F.col("t") < span))
        if not generation.limit(1).count():
            break
        every = every.union(generation)
    return every.select(F.concat(F.lit("e"), F.lpad(F.col("e").cast("string"), 2, "0")).alias("event"), F.round("t", 6).alias("timestamp"), "node")


def _poisson(mean: Column, seed: int, *keys, most: int = 40) -> Column:
    """Poisson draws by inversion for small means, by a rounded normal for large ones."""
    u = _uniform(seed + 31, *keys)
    large = F.greatest(F.round(mean + F.sqrt(mean) * noise("gauss", 1.0, seed + 57, *keys)), F.lit(0.0)).cast("int")
    step = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), step, lambda a, i: F.when(u > a["sum"], F.struct((a["p"] * mean / i).alias("p"), (a["sum"] + a["p"] * mean / i).alias("sum"), i.alias("k"))).otherwise(a), lambda a: a["k"]
    )
    return F.when(mean > 15, large).otherwise(walk)


# --- grids and named sets -------------------------------------------------------


def pendulum(spark: SparkSession) -> DataFrame:
    """Angles of a pendulum and a light, and where the shadow lies: angle, light, shade, middle (angles in degrees of 1/200 turn)."""
    angle = spark.range(-40, 44).select(F.col("id").cast("double").alias("angle"))
    light = spark.range(60, 148).filter("id <> 100").select(F.col("id").cast("double").alias("light"))
    theta, phi = F.col("angle") * math.pi / 200, F.col("light") * math.pi / 200
    x, y = 10 + 8 * F.sin(theta), 10.5 - 8 * F.cos(theta)
    ball_x, ball_y = 10 + 9.5 * F.sin(theta), 10.5 - 9.5 * F.cos(theta)
    down = lambda a, b: a - (b + 0.5) / F.tan(phi)  # noqa: E731  where a ray at the light's angle meets the ground
    top, low = down(F.lit(10.0), F.lit(10.5)), down(ball_x, ball_y)
    grid = angle.join(light, F.lit(True))
    return grid.select("angle", "light", F.greatest(F.abs(low - top), F.lit(3.0)).alias("shade"), ((top + low) / 2).alias("middle"), x.alias("x"), y.alias("y"))


def _iid_test(spark: SparkSession, n: int = 2000):
    w = random_dag("erdos_renyi", 10, 20, 1)
    return sample(spark, w, n, seed=1), edges_of(spark, w), None


def _thp_test(spark: SparkSession, span: float = 25000.0):
    graph, topology = random_dag("erdos_renyi", 10, 10, 2, (1, 1)) != 0, random_topology(20, 20, 2)
    rng = np.random.default_rng(2)
    log = cascade(spark, graph * rng.uniform(5e-3, 7e-3, graph.shape) * 20, rng.uniform(5e-5, 1e-4, 10), topology, span, 2, seed=2)
    return log, edges_of(spark, graph), edges_of(spark, topology)


datasets.register("iid_test", _iid_test)
datasets.register("thp_test", _thp_test)


def vector_sample(spark: SparkSession, w: np.ndarray, n: int, size: int, kind: int = 1, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows (row, x0 .. x{d-1}) of vector-valued variables (array<double>): each element follows
    2 sin(W'(x + 0.5)) + W'(x + 0.5) (kind 1), W' cos(x + 1) (kind 2) or 2 sin(W' cos(x + 1) + 0.5) + W' cos(x + 1) (kind 3) of its parents."""
    order = order_of(w != 0)
    if order is None:
        raise ValueError("the graph has a cycle")
    df = spark.range(n).withColumnRenamed("id", "row")
    for j in order:
        cells = []
        for k in range(size):
            at = {i: F.element_at(F.col(f"x{i}"), k + 1) for i in np.flatnonzero(w[:, j]).tolist()}
            inner = sum((float(w[i, j]) * (x + 0.5 if kind == 1 else F.cos(x + 1)) for i, x in at.items()), F.lit(0.0))
            value = 2 * F.sin(inner) + inner if kind == 1 else inner if kind == 2 else 2 * F.sin(inner + 0.5) + inner
            cells.append((value if at else F.lit(0.0)) + noise("gauss", scale, seed + 101 * k, F.col("row"), j))
        df = df.withColumn(f"x{j}", F.array(*cells))
    return df.select("row", *[f"x{j}" for j in range(len(w))])


def flow(spark: SparkSession) -> DataFrame:
    """Water that leaves a vessel: ball radius, water height, hole height, and how far the jet reaches."""
    ball = spark.range(5, 35).select((F.col("id") / 30.0).alias("ball"))
    water = spark.range(10, 40).select((F.col("id") / 10.0).alias("water"))
    hole = spark.range(6, 15).select((F.col("id") / 10.0).alias("hole"))
    height = F.col("water") + F.pow("ball", 3) / 10
    grid = ball.join(water, F.lit(True)).join(hole, F.lit(True)).filter(height > F.col("hole"))
    return grid.withColumn("height", height).withColumn("reach", F.sqrt(2 * 0.98 * F.greatest(height - F.col("hole"), F.lit(0.0))) * F.sqrt(2 * F.col("hole") / 9.8))


def second_order_sample(spark: SparkSession, w: np.ndarray, n: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows whose means are linear in the parents and in their products of two, with the same edge weights."""
    order = order_of(w != 0)
    if order is None:
        raise ValueError("the graph has a cycle")
    rng, df = np.random.default_rng(seed), spark.range(n).withColumnRenamed("id", "row")
    for j in order:
        parents = np.flatnonzero(w[:, j]).tolist()
        first = sum((float(w[i, j]) * F.col(f"x{i}") for i in parents), F.lit(0.0))
        second = sum((float(rng.uniform(0.5, 1.5) * rng.choice([-1, 1])) * F.col(f"x{a}") * F.col(f"x{b}") for k, a in enumerate(parents) for b in parents[k:]), F.lit(0.0))
        df = df.withColumn(f"x{j}", first + second + noise("gauss", scale, seed, F.col("row"), j))
    return df.select("row", *[f"x{j}" for j in range(len(w))])
