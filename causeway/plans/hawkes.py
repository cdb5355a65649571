"""Topological Hawkes processes: which event types raise the rate of which, at how many hops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from causeway.operators.frame import event_multiplicity
from causeway.operators.graph import k_hop_ring
from causeway.plans.base import Graph, Learner, learner


#: Largest exponent within a stretch of time, so that prefix sums of exponentials stay far from overflow; beyond
#: VANISHED a decay is zero in double precision. Fixed values of the number format.
STRETCH, VANISHED = 300.0, 745.0
#: Pieces that the whole span of time is cut into at least, so that no node's events are one sorted group.
PIECES = 256


def decay(events: DataFrame, rings: DataFrame, delta: float, held: list[DataFrame] | None = None) -> DataFrame:
    """(node, timestamp, event, times, hop, cause, decay): exp(-delta * age) summed over earlier events of each type
    at the nodes of each ring. events: node, timestamp, event, times; rings: node, hop, neighbour.

    The exponential factors, so a time needs a running sum over earlier times and not its pairs with them. Time is
    cut into pieces, and pieces are put together in stretches: sums run within a piece, over the pieces of a stretch,
    and over the last stretches, always from the start of each, where no factor overflows. Rows are in proportion to
    events and to results, and a busy node is sorted a piece at a time. With a list for held, tables that several steps
    read are persisted and put there, for the caller to give up; without one they are computed for each.
    """

    def kept(df: DataFrame) -> DataFrame:
        if held is not None:
            held.append(df.persist())
        return df

    keys = ["node", "hop", "cause"]
    earlier = events.groupBy("node", "timestamp", "event").agg(F.sum("times").alias("k")).select(F.col("node").alias("neighbour"), F.col("timestamp").alias("at"), F.col("event").alias("cause"), "k")
    low, high = events.agg(F.min("timestamp").cast("double"), F.max("timestamp").cast("double")).first()
    span = (high or 0.0) - (low or 0.0)
    width = min(STRETCH / delta if delta > 0 else np.inf, span / PIECES) or 1.0
    x = delta * width
    per = int(STRETCH / x) if x > STRETCH / 1e9 else 10**9
    reach = int(VANISHED / (x * per)) + 2 if x * per > 1 else 1

    sent = kept(earlier.join(rings, "neighbour").groupBy(*keys, "at").agg(F.sum("k").alias("k")))
    asked = events.select("node", F.col("timestamp").alias("at")).distinct().join(sent.select(*keys).distinct(), "node")
    marks = sent.select(*keys, "at", "k", F.lit(False).alias("asked")).unionByName(asked.select(*keys, "at", F.lit(0).cast("long").alias("k"), F.lit(True).alias("asked")))
    since = F.col("at").cast("double") - F.lit(low or 0.0)
    # Dealt by piece, in which times are put together, sorted, and met by what came before: one shuffle for all.
    marks = marks.withColumn("piece", F.floor(since / width)).repartition(*keys, "piece").groupBy(*keys, "piece", "at").agg(F.sum("k").alias("k"), F.max("asked").alias("asked")).withColumn("into", since - F.col("piece") * width)

    before = W.Window.partitionBy(*keys, "piece").orderBy("at").rowsBetween(W.Window.unboundedPreceding, -1)
    marks = kept(marks.withColumn("near", F.coalesce(F.sum(F.col("k") * F.exp(delta * F.col("into"))).over(before), F.lit(0.0)) * F.exp(-delta * F.col("into"))))
    pieces = marks.groupBy(*keys, "piece").agg(F.sum(F.col("k") * F.exp(-delta * (width - F.col("into")))).alias("left"), F.min(F.when(F.col("k") > 0, F.col("at"))).alias("first"))
    pieces = kept(pieces.withColumn("stretch", F.floor(F.col("piece") / per)).withColumn("place", F.col("piece") - F.col("stretch") * per))
    stretches = pieces.groupBy(*keys, "stretch").agg(F.sum(F.col("left") * F.exp(-x * (per - F.col("place") - 1))).alias("left"))
    onward = stretches.select(*keys, "left", "stretch", F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("j"))
    onward = onward.select(*keys, (F.col("stretch") + F.col("j") + 1).alias("stretch"), (F.col("left") * F.exp(-x * per * F.col("j"))).alias("far")).groupBy(*keys, "stretch").agg(F.sum("far").alias("far"))

    earlier_pieces = W.Window.partitionBy(*keys, "stretch").orderBy("piece").rowsBetween(W.Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum(F.col("left") * F.exp(x * F.col("place"))).over(earlier_pieces), F.lit(0.0)) * F.exp(-x * (F.col("place") - 1))
    starts = pieces.withColumn("middle", middle).withColumn("first", F.min("first").over(W.Window.partitionBy(*keys))).join(onward, [*keys, "stretch"], "left")
    starts = starts.select(*keys, "piece", "first", (F.col("middle") + F.coalesce("far", F.lit(0.0)) * F.exp(-x * F.col("place"))).alias("start"))
    sums = marks.filter("asked").join(starts, [*keys, "piece"]).filter("at > first")
    sums = sums.select(*keys, F.col("at").alias("timestamp"), (F.col("near") + F.col("start") * F.exp(-delta * F.col("into"))).alias("decay"))
    return events.join(sums, ["node", "timestamp"])


def mass(events: DataFrame, rings: DataFrame, delta: float) -> DataFrame:
    """(cause, hop, mass): the decay of every event over the time that is left, times the size of its ring."""
    last = events.agg(F.max("timestamp").alias("last")).withColumn("_one", F.lit(1))
    sizes = rings.groupBy("node", "hop").agg(F.count(F.lit(1)).alias("size"))
    left = events.join(F.broadcast(last), F.lit(1) == F.col("_one")).join(sizes, "node")
    part = (1 - F.exp(-delta * (F.col("last") - F.col("timestamp")))) / delta * F.col("times") * F.col("size")
    return left.groupBy(F.col("event").alias("cause"), "hop").agg(F.sum(part).alias("mass"))


@learner
class TTPM(Learner):
    """Hill climbing over edges by penalised likelihood, EM for the rates.

    Every climbing step evaluates all one-edge changes at once: an EM iteration of
    all of them is one pass over the rows, which carry their decays as an array.
    """

    def __init__(self, delta: float = 0.1, epsilon: float = 1.0, max_hop: int = 0, penalty: str = "BIC", max_iter: int = 20, required: list = (), forbidden: list = ()):
        if penalty not in ("BIC", "AIC"):
            raise ValueError("penalty is BIC or AIC")
        self.delta, self.epsilon, self.max_hop, self.penalty, self.max_iter = delta, epsilon, max_hop, penalty, max_iter
        self.required, self.forbidden = set(required), set(forbidden)

    def learn(self, log: DataFrame, topology: DataFrame | None = None) -> Graph:
        """log: event, timestamp, node (rows with a null are left out); topology: undirected edges (src, dst) of nodes."""
        spark = log.sparkSession
        events = event_multiplicity(log)
        nodes = events.select("node").distinct()
        rings = nodes.select("node", F.lit(0).alias("hop"), F.col("node").alias("neighbour"))
        if topology is not None:
            rings = k_hop_ring(topology, self.max_hop)
            events = events.join(rings.select("node").distinct(), "node", "left_semi")
        names = [r[0] for r in events.select("event").distinct().orderBy("event").collect()]
        d, hops = len(names), self.max_hop + 1
        code = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        events = events.withColumn("e", code[F.col("event")]).persist()
        span = events.agg(F.max("timestamp") - F.min("timestamp"), F.countDistinct("node"), F.sum("times")).first()
        exposure, total = float(span[0]) * span[1], float(span[2])
        masses = np.zeros((hops, d))
        for r in mass(events, rings, self.delta).collect():
            masses[r["hop"], names.index(r["cause"])] = r["mass"]
        held: list[DataFrame] = []
        sums = decay(events.select("node", "timestamp", "event", "times"), rings, self.delta, held).select("node", "timestamp", "event", "hop", "cause", "decay")
        packed = sums.groupBy("node", "timestamp", "event").agg(F.map_from_entries(F.collect_list(F.struct((F.col("hop") * d + code[F.col("cause")]).alias("k"), F.col("decay").alias("v")))).alias("m"))
        vector = F.transform(F.sequence(F.lit(0), F.lit(hops * d - 1)), lambda k: F.coalesce(F.element_at(F.col("m"), k), F.lit(0.0)))
        rows = events.join(packed, ["node", "timestamp", "event"], "left").select("e", F.col("times").cast("double").alias("times"), F.coalesce(vector, F.array_repeat(F.lit(0.0), F.lit(hops * d))).alias("decay")).persist()
        counts = np.zeros(d)
        for r in rows.groupBy("e").agg(F.sum("times").alias("n")).collect():
            counts[r["e"]] = r["n"]
        # The rows are there now, with all that EM needs.
        for df in held:
            df.unpersist()

        at = {n: i for i, n in enumerate(names)}
        must = {(at[a], at[b]) for a, b in self.required}
        never = {(at[a], at[b]) for a, b in self.forbidden}
        graph = np.eye(d, dtype=int)
        for a, b in must:
            graph[a, b] = 1
        best = np.array(self._scores(rows, [(j, tuple(np.flatnonzero(graph[:, j]))) for j in range(d)], masses, exposure, counts, d, hops, total))
        known = {}
        while True:
            moves = []
            for i in range(d):
                for j in range(d):
                    if i != j and (i, j) not in must and (i, j) not in never:
                        parents = set(np.flatnonzero(graph[:, j])) ^ {i}
                        moves.append((j, tuple(sorted(parents)), i))
            new = [m[:2] for m in moves if m[:2] not in known]
            known |= dict(zip(new, self._scores(rows, new, masses, exposure, counts, d, hops, total), strict=True))
            gains = [known[m[:2]] - best[m[0]] for m in moves]
            if not gains or max(gains) <= 0:
                break
            j, parents, i = moves[int(np.argmax(gains))]
            graph[i, j] ^= 1
            best[j] = known[j, parents]
        events.unpersist()
        rows.unpersist()
        return Graph([str(n) for n in names], graph, notes={"score": float(best.sum())})

    def _scores(self, rows: DataFrame, families: list, masses: np.ndarray, exposure: float, counts: np.ndarray, d: int, hops: int, total: float) -> list[float]:
        """Penalised log-likelihood of each (target, causes)."""
        if not families:
            return []
        targets = np.array([f[0] for f in families])
        use = np.zeros((len(families), hops * d))
        for f, (_, causes) in enumerate(families):
            for k in range(hops):
                use[f, [k * d + c for c in causes]] = 1
        weight = masses.ravel()
        mu = np.maximum(counts[targets], 1e-9) / max(exposure, 1e-9) / 2
        alpha = use * (counts[targets, None] / 2 / np.maximum((use * weight).sum(axis=1, keepdims=True), 1e-9))
        by_target = [np.flatnonzero(targets == j) for j in range(d)]
        last, likelihood = None, None
        for _ in range(self.max_iter):
            sums = self._pass(rows, mu, alpha, by_target, hops * d)
            likelihood = sums[:, 0] - (alpha * weight).sum(axis=1) - mu * exposure
            if last is not None and np.all(likelihood - last < 0.1):
                break
            last = likelihood
            mu = np.maximum(mu * sums[:, 1] / max(exposure, 1e-9), 1e-12)
            alpha = np.where(weight > 0, alpha * sums[:, 2:] / np.maximum(weight, 1e-300), 0) * use
        size = self.epsilon * (1 + np.array([len(f[1]) for f in families]) * hops)
        return list(likelihood - size * (np.log(max(total, 1)) / 2 if self.penalty == "BIC" else 1))

    @staticmethod
    def _pass(rows: DataFrame, mu: np.ndarray, alpha: np.ndarray, by_target: list[np.ndarray], k: int) -> np.ndarray:
        """For every family: sum of times * log rate, of times / rate, and of times * decay / rate, over its target's rows."""
        n = len(mu)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n, 2 + k))
            for batch in batches:
                if not batch.num_rows:
                    continue
                e, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = batch.column(2).flatten().to_numpy().reshape(-1, k)
                for j in np.unique(e):
                    f, at = by_target[j], e == j
                    if len(f):
                        rate = np.maximum(mu[f] + x[at] @ alpha[f].T, 1e-300)
                        share = times[at][:, None] / rate
                        out[f, 0] += times[at] @ np.log(rate)
                        out[f, 1] += share.sum(axis=0)
                        out[f, 2:] += share.T @ x[at]
            yield pa.RecordBatch.from_pydict({"f": pa.array(range(n), pa.int32()), "v": pa.array(list(out), pa.list_(pa.float64()))})

        sums = rows.mapInArrow(part, "f int, v array<double>").groupBy("f").agg(*[F.sum(F.element_at("v", i + 1)).alias(f"s{i}") for i in range(2 + k)])
        out = np.zeros((n, 2 + k))
        for r in sums.collect():
            out[r["f"]] = r[1:]
        return out
