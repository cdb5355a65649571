"""Policy-gradient searches with attention: over graphs (RL) and over orderings (CORL).

One pass over the rows gives the moments from which every candidate is scored. The policy
sees variables as tokens, each described by its values in some rows of a sample of bounded
size, and passes them through attention blocks. Rollouts, rewards and gradients are the work of Spark tasks:
in each round every task plays on its own draws for some steps, from the parameters
that all had at its start, and the mean of what the tasks come to starts the next round.
Draws follow from the seed, the round and the task's number, so a task that runs again
plays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.autodiff import ACTIVATIONS, Adam, Parameters, Value, exp, joined, log_softmax, relu, root, sigmoid, softmax, softplus, tanh
from causeway.functions.tails import matrix_exponential
from causeway.operators.moments import moments
from causeway.operators.scores import FamilyFit, prune_by_coefficient, prune_second_order
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.dense import is_acyclic
from causeway.plans.lingam import numbers

#: Rows of the sample that describes the variables to the policy.
POOL = 1024


def described(df: DataFrame, columns: list[str], rows: int = POOL) -> np.ndarray:
    """So many rows, standardised, those of the smallest hashes of their values: the same however the data is partitioned."""
    data = numbers(df, columns)
    some = data.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), *[F.col(f"`{c}`") for c in columns]).limit(rows).collect()
    x = np.array([list(r) for r in some], dtype=np.float64).reshape(-1, len(columns))
    return (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)


# --- networks --------------------------------------------------------------


def encoder_shapes(d: int, samples: int, width: int, blocks: int, kind: str) -> dict[str, tuple]:
    """Beside its values every variable has a vector of its own, so the policy need not tell variables by their values."""
    shapes: dict[str, tuple] = {"embed": (samples, width), "own": (d, width)}
    for k in range(blocks):
        if kind == "transformer":
            shapes |= {f"q{k}": (width, width), f"k{k}": (width, width), f"v{k}": (width, width), f"o{k}": (width, width)}
        if kind == "gat":
            shapes |= {f"v{k}": (width, width), f"left{k}": (width, 1), f"right{k}": (width, 1)}
        shapes |= {f"in{k}": (width, 2 * width), f"b_in{k}": (2 * width,), f"out{k}": (2 * width, width), f"b_out{k}": (width,), f"g_one{k}": (width,), f"b_one{k}": (width,), f"g_two{k}": (width,), f"b_two{k}": (width,)}
    return shapes


def normal(x: Value, gain: Value, shift: Value) -> Value:
    """Each token's vector with mean 0 and variance 1, scaled and shifted."""
    centred = x - x.mean(-1, keepdims=True)
    return centred / root((centred * centred).mean(-1, keepdims=True) + 1e-6) * gain + shift


def encode(p: dict[str, Value], tokens: np.ndarray, blocks: int, heads: int, kind: str) -> Value:
    """(batch, variables, width) of (batch, variables, samples): attention among the variables, then a layer for each, with residuals."""
    x = Value(tokens) @ p["embed"] + p["own"]
    b, d, width = x.shape
    for k in range(blocks):
        if kind == "transformer":
            q, key, v = (((x @ p[f"{n}{k}"]).reshape(b, d, heads, width // heads)).swap(1, 2) for n in "qkv")
            mixed = softmax(q @ key.swap() * (width // heads) ** -0.5) @ v
            x = normal(x + mixed.swap(1, 2).reshape(b, d, width) @ p[f"o{k}"], p[f"g_one{k}"], p[f"b_one{k}"])
        elif kind == "gat":
            v = x @ p[f"v{k}"]
            score = ACTIVATIONS["leaky_relu"](v @ p[f"left{k}"] + (v @ p[f"right{k}"]).swap())
            x = normal(x + softmax(score) @ v, p[f"g_one{k}"], p[f"b_one{k}"])
        x = normal(x + relu(x @ p[f"in{k}"] + p[f"b_in{k}"]) @ p[f"out{k}"] + p[f"b_out{k}"], p[f"g_two{k}"], p[f"b_two{k}"])
    return x


def edge_shapes(width: int, hidden: int, kind: str) -> dict[str, tuple]:
    if kind == "bilinear":
        return {"pair": (width, width), "b_edge": (1,)}
    shapes: dict[str, tuple] = {"cause": (width, hidden), "effect": (width, hidden), "turn": (hidden, 1), "b_edge": (1,)}
    return shapes | ({"tensor": (hidden, width, width)} if kind == "ntn" else {})


def edge_logits(p: dict[str, Value], e: Value, kind: str, activation: str) -> Value:
    """(batch, cause, effect)."""
    b, d, width = e.shape
    if kind == "bilinear":
        return e @ p["pair"] @ e.swap() * width**-0.5 + p["b_edge"]
    left, right = e @ p["cause"], e @ p["effect"]
    h = left.shape[-1]
    mixed = left.reshape(b, d, 1, h) + right.reshape(b, 1, d, h)
    if kind == "ntn":
        way = e.reshape(b, 1, d, width) @ p["tensor"] @ e.reshape(b, 1, d, width).swap() * (1 / width)  # (batch, hidden, cause, effect)
        mixed = mixed + way.swap(1, 2).swap(2, 3)
    return (ACTIVATIONS[activation](mixed) @ p["turn"]).reshape(b, d, d) + p["b_edge"]


def critic_shapes(width: int) -> dict[str, tuple]:
    return {"see": (width, width), "b_see": (width,), "judge": (width, 1), "b_judge": (1,)}


def judged(p: dict[str, Value], seen: np.ndarray) -> Value:
    return (relu(Value(seen) @ p["see"] + p["b_see"]) @ p["judge"] + p["b_judge"])[..., 0]


# --- rollouts --------------------------------------------------------------

#: One local step: (flat parameters, random generator, state of the task) -> (gradient, costs, candidates)
Play = Callable[[np.ndarray, np.random.Generator, dict], tuple[np.ndarray, np.ndarray, list]]


def play_rounds(spark: SparkSession, x: np.ndarray, play: Callable[[int], Play], rounds: int, tasks: int, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float, np.ndarray | None, list[float]]:
    """(parameters, least cost, its candidate, mean cost of each round). play(round) gives the step of that round's tasks.

    A task returns its parameters, its mean cost and its best candidate, so the driver sees `tasks` rows a round.
    """
    best, kept, course = np.inf, None, []
    for r in range(rounds):
        step = play(r)

        def work(batches: Iterator[pa.RecordBatch], x: np.ndarray = x, r: int = r, step: Play = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    rng, p, adam, state = np.random.default_rng([seed, r, task]), x.copy(), Adam(len(x), rate * decay**r), {}
                    least, candidate, total = np.inf, b"", 0.0
                    for _ in range(steps):
                        g, costs, found = step(p, rng, state)
                        p = adam.step(p, g / max(1.0, np.sqrt(g @ g)))
                        i = int(np.argmin(costs))
                        total += float(np.mean(costs)) / steps
                        if found[i] is not None and costs[i] < least:
                            least, candidate = float(costs[i]), np.asarray(found[i], dtype=np.int64).tobytes()
                    yield pa.RecordBatch.from_pydict({"x": [p.tobytes()], "cost": [total], "least": [least], "candidate": [candidate]})

        found = spark.range(0, tasks, 1, tasks).mapInArrow(work, "x binary, cost double, least double, candidate binary").collect()
        x = np.mean([np.frombuffer(f["x"]) for f in found], axis=0)
        course.append(float(np.mean([f["cost"] for f in found])))
        top = min(found, key=lambda f: (f["least"], f["candidate"]))
        if top["least"] < best:
            best, kept = top["least"], np.frombuffer(top["candidate"], dtype=np.int64)
    return x, best, kept, course


def tokens_of(pool: np.ndarray, rng: np.random.Generator, batch: int, samples: int) -> np.ndarray:
    return np.stack([pool[rng.integers(0, len(pool), samples)].T for _ in range(batch)])


def on_cycles(graphs: np.ndarray) -> np.ndarray:
    """Which edges of each graph lie on a cycle."""
    reach = graphs > 0
    for _ in range(max(1, int(np.ceil(np.log2(graphs.shape[1]))))):
        reach = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
    return (graphs > 0) & np.swapaxes(reach, 1, 2)


def graph_play(parameters: Parameters, pool: np.ndarray, fit: FamilyFit, low: float, high: float, penalties: tuple[float, float], options: dict) -> Play:
    """Draw graphs edge by edge, and move the policy towards those with a low score and no cycle."""
    d, batch = pool.shape[1], options["batch"]
    off = 1 - np.eye(d)
    scale = 5 / (abs(high - low) + 1e-9)

    def penalty(g: np.ndarray) -> float:
        """By the trace of the exponential, which is d without cycles."""
        return 0.0 if is_acyclic(g) else penalties[0] + penalties[1] * float(np.trace(matrix_exponential(g.astype(float))) - d)

    def step(x: np.ndarray, rng: np.random.Generator, state: dict) -> tuple[np.ndarray, np.ndarray, list]:
        p = parameters.values(x)
        e = encode(p, tokens_of(pool, rng, batch, options["samples"]), options["blocks"], options["heads"], options["encoder"])
        logits = edge_logits(p, e, options["decoder"], options["activation"])
        drawn = (rng.random((batch, d, d)) < 1 / (1 + np.exp(-logits.x))) * off
        graphs = drawn.astype(int)
        fines = np.array([penalty(g) for g in graphs])
        costs = np.array([(fit.graph(g) - low) * scale for g in graphs]) + fines
        state["base"] = costs.mean() if "base" not in state else options["alpha"] * state["base"] + (1 - options["alpha"]) * costs.mean()
        value = judged(p, e.x.mean(axis=1))
        # What is left of a variable depends on the edges into it alone, so only those answer for it. Without an edge that
        # lies on no cycle the fine would be the same, so only those on cycles answer for that.
        left, edges = fit.parts(graphs)
        parts = (left / left.sum(axis=1).mean() + edges if fit.equal else np.log(left + 1e-8) + edges) * scale
        gap = parts - parts.mean(axis=0) - (value.x - value.x.mean())[:, None] / d
        gap = gap[:, None, :] / (gap.std() + 1e-3) + drawn * on_cycles(graphs) * fines[:, None, None]
        surprise = softplus(-logits) * drawn + softplus(logits) * (off - drawn)  # minus the log of the draw's probability
        chance = sigmoid(logits) * off
        doubt = (softplus(logits) * off - chance * logits).sum() * (1 / batch)
        critic = (value - (costs - state["base"])) ** 2
        loss = -(surprise * gap).sum() * (1 / batch) - doubt * options["entropy"] + critic.mean() + chance.sum() * (options["l1"] / batch)
        return parameters.gradient(loss, p), costs, [g.ravel() if fine == 0 else None for g, fine in zip(graphs, fines, strict=True)]

    return step


def order_shapes(width: int, kind: str) -> dict[str, tuple]:
    shapes: dict[str, tuple] = {"first": (1, width), "look": (width, width), "ask": (width, width), "point": (width, 1)}
    if kind == "lstm":
        return shapes | {"cell": (2 * width, 4 * width), "b_cell": (4 * width,)}
    return shapes | {"far": (2 * width, width), "b_far": (width,)}


def order_play(parameters: Parameters, pool: np.ndarray, fit: FamilyFit, low: float, high: float, options: dict) -> Play:
    """Draw orderings variable by variable with a pointer; each variable is explained by those before it."""
    d, batch, dense = pool.shape[1], options["batch"], options["reward"] == "dense"
    each = np.arange(batch)

    def step(x: np.ndarray, rng: np.random.Generator, state: dict) -> tuple[np.ndarray, np.ndarray, list]:
        p = parameters.values(x)
        e = encode(p, tokens_of(pool, rng, batch, options["samples"]), options["blocks"], options["heads"], options["encoder"])
        width, look, all_tokens = e.shape[-1], e @ p["look"], e.mean(1)
        h, c, last = all_tokens, Value(np.zeros((batch, width))), Value(np.zeros((batch, width))) + p["first"]
        taken, orders, surprise, seen = np.zeros((batch, d)), np.zeros((batch, d), dtype=int), [], []
        chosen_sum = Value(np.zeros((batch, width)))
        for t in range(d):
            if options["decoder"] == "lstm":
                gates = joined([last, h]) @ p["cell"] + p["b_cell"]
                i, f, o, new = (gates[:, k * width : (k + 1) * width] for k in range(4))
                c = sigmoid(f + 1.0) * c + sigmoid(i) * tanh(new)
                h = sigmoid(o) * tanh(c)
            else:
                h = tanh(joined([all_tokens, chosen_sum * (1 / max(t, 1))]) @ p["far"] + p["b_far"])
            logits = (tanh(look + (h @ p["ask"]).reshape(batch, 1, width)) @ p["point"]).reshape(batch, d) * options["clip"] + taken * -1e9
            logs = log_softmax(logits)
            at = (rng.random((batch, 1)) > np.cumsum(np.exp(logs.x), axis=1)).sum(axis=1)
            at = np.where(taken[each, np.minimum(at, d - 1)] > 0, np.argmin(taken, axis=1), np.minimum(at, d - 1))
            surprise.append(-logs[each, at])
            seen.append(h.x)
            taken[each, at], orders[:, t] = 1, at
            last = e[each, at]
            chosen_sum = chosen_sum + last
        terms = np.array([[fit.term(o[t], o[:t]) for t in range(d)] for o in orders.tolist()]) / (abs(high - low) + 1e-9) * 5
        costs = np.array([(fit.total([tuple(o[:t]) for t in range(d)], o) - low) / (abs(high - low) + 1e-9) * 5 for o in orders.tolist()])
        if dense:
            ahead = np.zeros_like(terms)
            for t in reversed(range(d)):
                ahead[:, t] = terms[:, t] + (options["gamma"] * ahead[:, t + 1] if t + 1 < d else 0)
            goal, sight = ahead - ahead.mean(axis=0), np.stack(seen, axis=1)
        else:
            state["base"] = costs.mean() if "base" not in state else options["alpha"] * state["base"] + (1 - options["alpha"]) * costs.mean()
            goal, sight = (costs - state["base"])[:, None], e.x.mean(axis=1)[:, None]
        value = judged(p, sight)
        gap = goal - value.x
        gap = gap / (gap.std() + 1e-3)
        loss = ((value - goal) ** 2).mean()
        for t, s in enumerate(surprise):
            loss = loss - (s * gap[:, t if dense else 0]).mean()
        return parameters.gradient(loss, p), costs, list(orders)

    return step


# --- learners --------------------------------------------------------------


class _Policy(Learner):
    def _pruned(self, df: DataFrame, columns: list[str], graph: np.ndarray) -> np.ndarray:
        if self.regression == "QR":
            from causeway.operators.scores import family_moments

            return prune_second_order(family_moments(df, columns, 2), columns, graph, self.threshold)
        return prune_by_coefficient(moments(df, columns), graph, self.threshold)


@learner
class RL(_Policy):
    """Search over graphs by an actor that draws every edge, and a critic.

    encoder: transformer, gat or none; decoder: single, bilinear or ntn; activation: of the decoder; score: BIC (one
    variance for all) or BIC_different_var; regression: LR, QR (products of two parents) or GPR (an additive Gaussian
    process). A graph with a cycle costs penalties that grow every penalty_rounds rounds; the best acyclic graph
    is pruned by its coefficients. Each round, `tasks` tasks play `steps` batches.
    """

    def __init__(self, encoder: str = "transformer", hidden: int = 32, heads: int = 4, blocks: int = 2, decoder: str = "single", decoder_hidden: int = 16, activation: str = "tanh", bias: float = -2.0, batch: int = 32, samples: int = 32,
                 score: str = "BIC", regression: str = "LR", rounds: int = 24, steps: int = 10, tasks: int = 8, rate: float = 3e-3, decay: float = 0.98, alpha: float = 0.9, entropy: float = 1e-3, l1: float = 0.0, penalty_rounds: int = 8, threshold: float = 0.3, seed: int = 0):
        if encoder not in ("transformer", "gat", "none") or decoder not in ("single", "bilinear", "ntn") or regression not in ("LR", "QR", "GPR") or score not in ("BIC", "BIC_different_var") or activation not in ACTIVATIONS:
            raise ValueError("unknown encoder, decoder, activation, score or regression")
        self.encoder, self.hidden, self.heads, self.blocks, self.decoder, self.decoder_hidden, self.activation, self.bias = encoder, hidden, heads, blocks, decoder, decoder_hidden, activation, bias
        self.batch, self.samples, self.score, self.regression, self.rounds, self.steps, self.tasks, self.rate, self.decay = batch, samples, score, regression, rounds, steps, tasks, rate, decay
        self.alpha, self.entropy, self.l1, self.penalty_rounds, self.threshold, self.seed = alpha, entropy, l1, penalty_rounds, threshold, seed

    def network(self, d: int) -> Parameters:
        blocks = 0 if self.encoder == "none" else self.blocks
        return Parameters(encoder_shapes(d, self.samples, self.hidden, blocks, self.encoder) | edge_shapes(self.hidden, self.decoder_hidden, self.decoder) | critic_shapes(self.hidden))

    def options(self) -> dict:
        return {"batch": self.batch, "samples": self.samples, "blocks": 0 if self.encoder == "none" else self.blocks, "heads": self.heads, "encoder": self.encoder, "decoder": self.decoder, "activation": self.activation, "alpha": self.alpha, "entropy": self.entropy, "l1": self.l1}

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        d = len(columns)
        parameters = self.network(d)
        pool, fit = described(df, columns), FamilyFit(df, columns, self.regression, self.score == "BIC")
        low, high = fit.bounds()
        x = parameters.start(np.random.default_rng(self.seed), {"turn": 0.3, "own": 1.0})
        x[_places(parameters, "b_edge")] = self.bias
        grow = 10.0 ** -min(12, round(d / 3))

        def play(r: int) -> Play:
            k = r // self.penalty_rounds
            return graph_play(parameters, pool, fit, low, high, (min(5.0, 1.0 + k / 2), min(0.1, grow * 10 ** (k + 2))), self.options())

        x, best, kept, course = play_rounds(df.sparkSession, x, play, self.rounds, self.tasks, self.steps, self.rate, self.decay, self.seed)
        graph = np.zeros((d, d), dtype=int) if kept is None else kept.reshape(d, d).astype(int)
        return Graph(list(columns), self._pruned(df, columns, graph), notes={"cost": best, "course": course, "graph": graph})


@learner
class CORL(_Policy):
    """Search over orderings by a pointer decoder: the whole graph of the best ordering is pruned by its coefficients.

    encoder: transformer, gat or mlp; decoder: lstm or mlp; reward: episodic (one for the ordering) or dense (each
    variable's own, discounted by gamma); regression and score as for RL.
    """

    def __init__(self, encoder: str = "transformer", hidden: int = 32, heads: int = 4, blocks: int = 2, decoder: str = "lstm", batch: int = 32, samples: int = 32, reward: str = "episodic", score: str = "BIC", regression: str = "LR",
                 rounds: int = 25, steps: int = 8, tasks: int = 8, rate: float = 3e-3, decay: float = 0.98, alpha: float = 0.9, gamma: float = 0.98, clip: float = 5.0, threshold: float = 0.3, seed: int = 0):
        if encoder not in ("transformer", "gat", "mlp") or decoder not in ("lstm", "mlp") or reward not in ("episodic", "dense") or regression not in ("LR", "QR", "GPR") or score not in ("BIC", "BIC_different_var"):
            raise ValueError("unknown encoder, decoder, reward, score or regression")
        self.encoder, self.hidden, self.heads, self.blocks, self.decoder, self.batch, self.samples, self.reward = encoder, hidden, heads, blocks, decoder, batch, samples, reward
        self.score, self.regression, self.rounds, self.steps, self.tasks, self.rate, self.decay, self.alpha, self.gamma, self.clip, self.threshold, self.seed = score, regression, rounds, steps, tasks, rate, decay, alpha, gamma, clip, threshold, seed

    def network(self, d: int) -> Parameters:
        return Parameters(encoder_shapes(d, self.samples, self.hidden, self.blocks, self.encoder) | order_shapes(self.hidden, self.decoder) | critic_shapes(self.hidden))

    def options(self) -> dict:
        return {"batch": self.batch, "samples": self.samples, "blocks": self.blocks, "heads": self.heads, "encoder": self.encoder, "decoder": self.decoder, "reward": self.reward, "alpha": self.alpha, "gamma": self.gamma, "clip": self.clip}

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        d = len(columns)
        parameters = self.network(d)
        pool, fit = described(df, columns), FamilyFit(df, columns, self.regression, self.score == "BIC", penalised=False)
        low, high = fit.bounds()
        x = parameters.start(np.random.default_rng(self.seed), {"own": 1.0})
        play = order_play(parameters, pool, fit, low, high, self.options())
        x, best, kept, course = play_rounds(df.sparkSession, x, lambda r: play, self.rounds, self.tasks, self.steps, self.rate, self.decay, self.seed)
        order = list(range(d)) if kept is None else kept.tolist()
        graph = np.zeros((d, d), dtype=int)
        for t, j in enumerate(order):
            graph[order[:t], j] = 1
        return Graph(list(columns), self._pruned(df, columns, graph), notes={"order": order, "cost": best, "course": course})


def _places(parameters: Parameters, name: str) -> slice:
    edges = np.concatenate([[0], parameters.cuts, [parameters.size]])
    k = list(parameters.shapes).index(name)
    return slice(int(edges[k]), int(edges[k + 1]))
