"""Nonlinear learners with small networks, trained where the rows are.

Rows are dealt to shards by a hash of their values. Each round broadcasts the parameters; Adam steps over a shard's rows
give that shard's parameters, and the mean of all shards' by rows starts the next round. A task has many shards, takes
the steps of TOGETHER of them at once and sends one sum back. The penalties (sparsity, acyclicity) are part of each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.layers import networks, one_network
from causeway.operators.lowrank import batch_totals
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.dense import acyclicity, acyclicity_power, cut_to_dag

#: Where weights are taken relative to the largest and all are smaller than this, nothing explains anything.
LEAST_WEIGHT = 0.02
#: gradient at (parameters, batch of rows, rho, alpha), or of each of several shards: parameters (shard, number), rows (shard, row, column),
#: and by name the share that each row has in its shard's mean, (shard, row, 1): batches differ in length, and what is beyond one counts 0
Step = Callable[..., np.ndarray]


#: Rows of a shard; shards that a task trains at once; tasks there are at least, if there are so many shards, and shards of a task beyond.
SHARD, TOGETHER, TASKS, SHARDS_A_TASK = 10_000, 64, 32, 64


def dealt(df: DataFrame, columns: list[str], rows_a_shard: int = SHARD) -> DataFrame:
    """The columns of the complete rows, standardised, a number _u from 0 to 1 that their values determine, and their _shard.

    Rows are dealt to as many shards as their number needs and sorted, both by a hash of their values: every
    shard sees the same batches, however the data was partitioned.
    """
    names = [F.col(f"`{c}`") for c in columns]
    raw = df.select(*[c.cast("double").alias(n) for c, n in zip(names, columns, strict=True)]).na.drop("any").withColumn("_h", F.xxhash64(*names))
    n, *stats = raw.agg(F.count(F.lit(1)), *[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    shards = max(1, -(-n // rows_a_shard))
    tasks = min(shards, max(TASKS, -(-shards // SHARDS_A_TASK)))
    raw = raw.withColumn("_shard", F.pmod(F.hash("_h"), F.lit(shards)))
    raw = raw.repartitionById(tasks, F.col("_shard") % tasks).sortWithinPartitions("_shard", "_h", *names)
    # Means and deviations are literals: a join would lose the order.
    scaled = [((c - (stats[2 * k] or 0.0)) / (stats[2 * k + 1] or 1.0)).alias(columns[k]) for k, c in enumerate(names)]
    return raw.select(*scaled, (F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) / float(1 << 20)).alias("_u"), "_shard")


class Draws:
    """Random numbers of several shards, each from its own generator. rows: how many of a batch's rows are a shard's."""

    def __init__(self, of: list[np.random.Generator], rows: list[int]):
        self.of, self.rows = of, rows

    def uniform(self, low: float, high: float, size: tuple) -> np.ndarray:
        return np.stack([g.uniform(low, high, size[1:]) for g in self.of])

    def normal(self, size: tuple) -> np.ndarray:
        out = np.zeros(size)
        for k, (g, n) in enumerate(zip(self.of, self.rows, strict=True)):
            out[k, :n] = g.normal(size=(n, *size[2:]))
        return out


def shares(data: np.ndarray, share: np.ndarray | None) -> np.ndarray | float:
    """What a row counts in the mean over the rows of its batch."""
    return 1 / data.shape[-2] if share is None else share


def packed(rows: DataFrame) -> DataFrame:
    """The same rows as arrays of doubles, 2 * SHARD rows in one at most, beside their _shard: every round reads them again."""
    width = len(rows.columns) - 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, data in _shards(batches):
            for a in range(0, len(data), 2 * SHARD):
                yield pa.RecordBatch.from_pydict({"_rows": [data[a : a + 2 * SHARD].tobytes()], "_width": pa.array([width], pa.int32()), "_shard": pa.array([number], pa.int32())})

    return rows.mapInArrow(pack, "_rows binary, _width int, _shard int")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(number, rows) of each shard of a task, from what packed() gives."""
    pieces = ((number.as_py(), np.frombuffer(v.as_buffer()).reshape(-1, width.as_py())) for b in batches for v, width, number in zip(*b.columns, strict=True))
    for number, parts in groupby(pieces, itemgetter(0)):
        data = [part for _, part in parts]
        yield number, data[0] if len(data) == 1 else np.concatenate(data)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(number, rows) of each shard of a task, whose rows come in the order of shards; the last column is the number."""
    at, parts = None, []
    for b in batches:
        *columns, numbers = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        data = np.column_stack(columns)
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for part, start in zip(np.split(data, cuts), [0, *cuts], strict=True):
            if len(part):
                if parts and numbers[start] != at:
                    yield at, np.concatenate(parts)
                    parts = []
                at = int(numbers[start])
                parts.append(part)
    if parts:
        yield at, np.concatenate(parts)


def _batches(shards: list[np.ndarray], batch: int, rngs: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each shard, at most SHARD, shuffled: (shard, step, row, column), and the length of each batch: (shard, step).

    Batches of a shard differ by a row at most; what is beyond a batch is 0, and shards with fewer steps have batches of no rows.
    """
    steps = [max(1, len(data) // batch) for data in shards]
    sizes = np.zeros((len(shards), max(steps)), dtype=int)
    for k, (data, m) in enumerate(zip(shards, steps, strict=True)):
        sizes[k, :m] = len(data) // m + (np.arange(m) < len(data) % m)
    width = shards[0].shape[1]
    rows = np.zeros((*sizes.shape, sizes.max(), width))
    for k, (data, m, rng) in enumerate(zip(shards, steps, rngs, strict=True)):
        size, longer = divmod(len(data), m)
        mixed, cut = data[rng.permutation(len(data))], longer * (size + 1)
        if longer:
            rows[k, :longer, : size + 1] = mixed[:cut].reshape(longer, size + 1, width)
        rows[k, longer:m, :size] = mixed[cut:].reshape(m - longer, size, width)
    return rows, sizes


def _steps(shards: list[tuple[int, np.ndarray]], gradient: Step, x: np.ndarray, rho: float, alpha: float, rate: float, batch: int, seed: int) -> np.ndarray:
    """The parameters of each shard after one pass of Adam steps over its rows, all of which start from x."""
    draws = getattr(gradient, "draws", False)
    rngs = [np.random.default_rng([seed, number]) for number, _ in shards]
    p = np.tile(x, (len(shards), 1))
    one, two, t = np.zeros_like(p), np.zeros_like(p), 0
    for a in range(0, max(len(data) for _, data in shards), SHARD):
        there = [k for k, (_, data) in enumerate(shards) if len(data) > a]
        rows, sizes = _batches([shards[k][1][a : a + SHARD] for k in there], batch, [rngs[k] for k in there])
        share = (np.arange(rows.shape[2]) < sizes[..., None])[..., None] / np.maximum(sizes, 1)[..., None, None]
        for step in range(sizes.shape[1]):
            live = np.flatnonzero(sizes[:, step])
            which = slice(None) if len(live) == len(shards) else [there[k] for k in live]
            of = slice(None) if len(live) == len(there) else live
            more = (Draws([rngs[there[k]] for k in live], sizes[live, step].tolist()),) if draws else ()
            g = gradient(p[which], rows[of, step], rho, alpha, *more, share=share[of, step])
            t += 1
            one[which] = 0.9 * one[which] + 0.1 * g
            two[which] = 0.999 * two[which] + 0.001 * g * g
            p[which] -= rate * (one[which] / (1 - 0.9**t)) / (np.sqrt(two[which] / (1 - 0.999**t)) + 1e-8)
    return p


def average_training(rows: DataFrame, gradient: Step, x: np.ndarray, rho: float, alpha: float, rounds: int, rate: float, batch: int, seed: int) -> np.ndarray:
    """Rounds of local Adam passes over the shards that rows has (its last column), and averages of their parameters.

    rows may be packed. A gradient with a true attribute draws also gets the shards' random numbers.
    """
    shards_of = _unpacked if rows.columns[0] == "_rows" else _shards
    for r in range(rounds):

        def train(batches: Iterator[pa.RecordBatch], x: np.ndarray = x, r: int = r) -> Iterator[pa.RecordBatch]:
            total, n, shards = np.zeros_like(x), 0.0, shards_of(batches)
            while some := list(islice(shards, TOGETHER)):
                p, sizes = _steps(some, gradient, x, rho, alpha, rate, batch, seed + r), np.array([float(len(data)) for _, data in some])
                total, n = total + sizes @ p, n + sizes.sum()
            if n:
                yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": [total.tobytes()], "n": [n]})

        # Sums in the order of the tasks, so that they are the same in every run.
        found = rows.mapInArrow(train, "task int, v binary, n double").groupBy(F.col("task") % 8).applyInArrow(_added, "task int, v binary, n double").collect()
        if not found:
            return x
        found = sorted(found, key=lambda f: f["task"])
        x = sum(np.frombuffer(f["v"]) for f in found) / sum(f["n"] for f in found)
    return x


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("task")
    total = sum(np.frombuffer(v) for v in table.column("v").to_pylist())
    return pa.table({"task": table.column("task")[:1].cast(pa.int32()), "v": pa.array([total.tobytes()]), "n": pa.array([sum(table.column("n").to_pylist())])})


class _Network(Learner):
    """Augmented Lagrangian around average_training(). Subclasses give start(), gradient() and weights()."""

    mask: np.ndarray | None = None
    holdout = 0.0

    def __init__(self, hidden: int = 8, lambda1: float = 0.01, max_iter: int = 6, rounds: int = 6, rate: float = 0.02, batch: int = 64, h_tol: float = 1e-4, rho_max: float = 1e6, threshold: float = 0.3, seed: int = 0):
        self.hidden, self.lambda1, self.max_iter, self.rounds, self.rate, self.batch = hidden, lambda1, max_iter, rounds, rate, batch
        self.h_tol, self.rho_max, self.threshold, self.seed = h_tol, rho_max, threshold, seed

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        # Means, deviations and the shards are all of these rows; what df is made by may be costly and runs once.
        own = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).na.drop("any").persist()
        rows, train = dealt(own, columns).persist(), None
        given, d = self.mask, self.variables(columns)
        try:
            chosen = self.allowed(rows, columns)
            if chosen is not None:
                self.mask = chosen if given is None else chosen * given
            preselection = None if self.mask is None else np.array(self.mask)
            train = packed(rows.filter(F.col("_u") >= self.holdout).drop("_u")).persist()
            aside = rows.filter(F.col("_u") < self.holdout).drop("_u", "_shard") if self.holdout else None
            rho, alpha, last = 1.0, 0.0, np.inf
            x = self.start(d, np.random.default_rng(self.seed))
            for k in range(self.max_iter):
                self.begin(k)
                x = self.trained(train, aside, x, d, rho, alpha, self.seed + 1000 * k)
                h = self.constraint(self.weights(x, d))[0]
                alpha += rho * h
                rho = min(self.rho_max, rho * 10) if h > 0.25 * last else rho
                last = h
                if h < self.h_tol:
                    break
            w = self.strengths(rows.drop("_u", "_shard"), columns, x)
        finally:
            self.mask = given
            own.unpersist()
            rows.unpersist()
            if train is not None:
                train.unpersist()
        w = w / max(np.abs(w).max(), LEAST_WEIGHT) if self.relative else w
        w = cut_to_dag(w, self.threshold)
        matrix = self.pruned(df, columns, (w != 0).astype(int))
        return Graph(list(columns), matrix, w * matrix, notes={"preselection": preselection})

    def trained(self, train: DataFrame, aside: DataFrame | None, x: np.ndarray, d: int, rho: float, alpha: float, seed: int) -> np.ndarray:
        """All rounds of a step, or those up to the first that does not lessen the loss of the rows set aside."""
        if aside is None:
            return average_training(train, self.gradient(d), x, rho, alpha, self.rounds, self.rate, self.batch, seed)
        best = np.inf
        for r in range(self.rounds):
            new = average_training(train, self.gradient(d), x, rho, alpha, 1, self.rate, self.batch, seed + r)
            loss = batch_totals(aside, lambda data, new=new: np.array([self.held_out(new, data)]), 1)[0]
            if loss >= best:
                break
            x, best = new, loss
        return x

    def begin(self, step: int) -> None:
        """Called before each step of the multiplier method."""

    def variables(self, columns: list[str]) -> int:
        return len(columns)

    def allowed(self, rows: DataFrame, columns: list[str]) -> np.ndarray | None:
        """A preselection of edges, from the rows."""
        return None

    def pruned(self, df: DataFrame, columns: list[str], graph: np.ndarray) -> np.ndarray:
        return graph

    def strengths(self, rows: DataFrame, columns: list[str], x: np.ndarray) -> np.ndarray:
        """What the threshold and the cut to a DAG go by."""
        return self.weights(x, self.variables(columns))

    relative = False
    constraint = staticmethod(acyclicity_power)


@learner
class NotearsNetwork(_Network):
    """One hidden layer for every variable; an edge's strength is the norm of the weights from cause to layer."""

    def _split(self, x: np.ndarray, d: int):
        m, many = self.hidden, x.shape[:-1]
        a = x[..., : d * d * m].reshape(*many, d, d, m)  # cause, variable, unit
        b = x[..., d * d * m : d * d * m + d * m].reshape(*many, d, m)
        c = x[..., d * d * m + d * m : d * d * m + 2 * d * m].reshape(*many, d, m)
        return a, b, c, x[..., -d:]

    def start(self, d: int, rng: np.random.Generator) -> np.ndarray:
        m = self.hidden
        return np.concatenate([rng.normal(0, 0.1, d * d * m), np.zeros(d * m), rng.normal(0, 0.5, d * m), np.zeros(d)])

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        a = self._split(x, d)[0]
        return np.sqrt((a * a).sum(axis=2)) * (1 - np.eye(d))

    def gradient(self, d: int) -> Step:
        m, lambda1, split = self.hidden, self.lambda1, self._split
        off = (1 - np.eye(d))[:, :, None]

        def f(x: np.ndarray, data: np.ndarray, rho: float, alpha: float, share: np.ndarray | None = None) -> np.ndarray:
            a, b, c, c0 = split(x, d)
            a = a * off
            y, back = networks(data, a, b, [], c, c0, "sigmoid")
            g_a, g_b, _, g_c, g_c0 = back((y - data) * shares(data, share))
            w = np.sqrt((a * a).sum(axis=-1) + 1e-8)
            h, grad_h = acyclicity_power(w * off[:, :, 0])
            penalty = np.asarray(rho * h + alpha)[..., None, None] * grad_h + lambda1
            g_a = (g_a + (penalty / w)[..., None] * a) * off
            return np.concatenate([v.reshape(*x.shape[:-1], -1) for v in (g_a, g_b, g_c + 1e-3 * c, g_c0)], axis=-1)

        return f


@learner
class GraphAutoencoder(_Network):
    """x is coded by one small network for all variables, passed along the edges, and decoded by another; weights are
    taken relative to the largest before the threshold."""

    relative = True
    constraint = staticmethod(acyclicity)

    def _split(self, x: np.ndarray, d: int):
        m = self.hidden
        return x[..., : d * d].reshape(*x.shape[:-1], d, d), x[..., d * d : d * d + 3 * m + 1], x[..., d * d + 3 * m + 1 :]

    def start(self, d: int, rng: np.random.Generator) -> np.ndarray:
        m = self.hidden
        net = lambda: np.concatenate([rng.normal(0, 1, m), rng.normal(0, 0.3, m), rng.normal(0, 1 / m**0.5, m), [0.0]])
        return np.concatenate([rng.normal(0, 0.1, d * d), net(), net()])

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        return x[: d * d].reshape(d, d) * (1 - np.eye(d))

    def gradient(self, d: int) -> Step:
        m, lambda1, split, off = self.hidden, self.lambda1, self._split, 1 - np.eye(d)

        def net(p: np.ndarray, v: np.ndarray):
            """The network at all numbers of v, and what gives the derivatives by p and v."""
            way, bias, out = (p[..., k * m : (k + 1) * m] for k in range(3))
            last = np.concatenate([out, 0 * p[..., -1:], p[..., -1:]], axis=-1)[..., None, :]
            y, back = one_network(np.stack([way, bias], axis=-1), last, v.reshape(*v.shape[:-2], 1, -1))

            def own(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                first, last, g_v = back(g.reshape(*v.shape[:-2], 1, -1))
                return np.concatenate([first[..., 0], first[..., 1], last[..., 0, :m], last[..., 0, -1:]], axis=-1), g_v.reshape(v.shape)

            return y.reshape(v.shape), own

        def f(x: np.ndarray, data: np.ndarray, rho: float, alpha: float, share: np.ndarray | None = None) -> np.ndarray:
            a, enc, dec = split(x, d)
            a = a * off
            code, enc_back = net(enc, data)
            mixed = code @ a
            out, dec_back = net(dec, mixed)
            g_dec, g_mixed = dec_back((out - data) * shares(data, share))
            g_enc, _ = enc_back(g_mixed @ np.swapaxes(a, -1, -2))
            h, grad_h = acyclicity(a)
            g_a = (np.swapaxes(code, -1, -2) @ g_mixed + lambda1 * np.sign(a) + np.asarray(rho * h + alpha)[..., None, None] * grad_h) * off
            return np.concatenate([g_a.reshape(*a.shape[:-2], -1), g_enc, g_dec], axis=-1)

        return f
