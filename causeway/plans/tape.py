"""Network learners whose losses are written down and differentiated by functions/autodiff: deeper networks by likelihood,
Gumbel masks, variational autoencoders and vector-valued variables. All train in the tasks (neural.average_training)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.autodiff import ACTIVATIONS, Parameters, Value, absolute, exp, from_rule, inverse, root, sigmoid, together
from causeway.functions.layers import networks, one_network, turned
from causeway.functions.tails import matrix_exponential
from causeway.plans.base import Graph, learner
from causeway.plans.dense import acyclicity, acyclicity_power
from causeway.plans.neural import Draws, Step, _Network, shares


class _Tape(_Network):
    """Subclasses give shapes(d), loss(p, data, rho, alpha, rng, share) and weights(x, d).

    A loss of several shards at once (an axis before the others) is their sum; share: what each row counts in its shard's mean.
    """

    #: Standard deviations of the draws that parameters start from, where they are not their usual ones.
    scale: dict[str, float] = {}

    def shapes(self, d: int) -> dict[str, tuple]:
        raise NotImplementedError

    def loss(self, p: dict[str, Value], data: np.ndarray, rho: float, alpha: float, rng: np.random.Generator | Draws, share: np.ndarray | None = None) -> Value:
        raise NotImplementedError

    def parameters(self, d: int) -> Parameters:
        return Parameters(self.shapes(d))

    def start(self, d: int, rng: np.random.Generator) -> np.ndarray:
        return self.parameters(d).start(rng, self.scale)

    def part(self, x: np.ndarray, d: int, name: str) -> np.ndarray:
        return self.parameters(d).values(x)[name].x

    def gradient(self, d: int) -> Step:
        parameters = self.parameters(d)

        def f(x: np.ndarray, data: np.ndarray, rho: float, alpha: float, rng: np.random.Generator | Draws, share: np.ndarray | None = None) -> np.ndarray:
            p = parameters.values(x)
            return parameters.gradient(self.loss(p, data, rho, alpha, rng, share), p)

        f.draws = True
        return f

    def held_out(self, x: np.ndarray, data: np.ndarray) -> float:
        """The loss without penalties, summed over rows that are not trained on."""
        p = self.parameters(self.width(data)).values(x)
        return float(self.loss(p, data, 0.0, 0.0, np.random.default_rng(self.seed)).x) * len(data)

    def width(self, data: np.ndarray) -> int:
        return data.shape[-1]

    def off(self, d: int) -> np.ndarray:
        """Which edges there may be."""
        return (1 - np.eye(d)) * (1 if self.mask is None else np.asarray(self.mask, dtype=float))

    def penalty(self, w: Value, rho: float, alpha: float) -> Value:
        h, slope = self.constraint(w.x)
        h = from_rule(w, h, slope)
        return (h * h * (0.5 * rho) + h * alpha).sum()


def across(v: Value) -> Value:
    """A vector that is the same for all rows."""
    return v.reshape(*v.shape[:-1], 1, v.shape[-1])


def per_variable(p: dict[str, Value], data: np.ndarray, seen: Value | np.ndarray, layers: int, activation: str) -> Value:
    """(n, d): the output of every variable's own network over the variables that it sees."""
    a = p["a0"] * (seen if isinstance(seen, Value) else Value(seen)).reshape(*np.shape(seen.x if isinstance(seen, Value) else seen), 1)  # cause, variable, unit
    inner = [v for k in range(1, layers) for v in (p[f"a{k}"], p[f"b_{k}"])]
    x = [v.x for v in inner]
    deeper = [(w, b[..., 0, :]) for w, b in zip(x[::2], x[1::2], strict=True)]
    y, back = networks(data, a.x, p["b_0"].x[..., 0, :], deeper, p["out"].x[..., 0], p["b_out"].x[..., 0], activation)

    def each(g: np.ndarray) -> list[np.ndarray]:
        g_a, g_b, found, g_out, g_b_out = back(g)
        return [g_a, g_b[..., None, :], *(v for w, b in found for v in (w, b[..., None, :])), g_out[..., None], g_b_out[..., None]]

    return together(y, [a, p["b_0"], *inner, p["out"], p["b_out"]], each)


def network_shapes(d: int, hidden: int, layers: int) -> dict[str, tuple]:
    shapes: dict[str, tuple] = {"a0": (d, d, hidden), "b_0": (d, 1, hidden)}
    for k in range(1, layers):
        shapes |= {f"a{k}": (d, hidden, hidden), f"b_{k}": (d, 1, hidden)}
    return shapes | {"out": (d, hidden, 1), "b_out": (d, 1)}


@learner
class GraNDAG(_Tape):
    """Each variable is Gaussian about the output of its own network over the others.

    During training the strength of an edge is the sum over paths of absolute weights (normalise: as a share of all
    paths to its variable), which h = tr(exp) - d makes acyclic. In the end edges are judged by the mean absolute derivative
    over the rows. neighbours: preselect so many causes a variable at most, by the importances of randomised
    regression trees (0: none). holdout: share of rows whose likelihood ends the rounds of a step early. cutoff:
    prune by F tests of additive curves (1: not). mask: 0 where an edge i -> j is ruled out.
    """

    scale = {"a0": 0.3, "out": 0.3}

    def __init__(self, hidden: int = 8, lambda1: float = 0.01, max_iter: int = 6, rounds: int = 6, rate: float = 0.02, batch: int = 64, h_tol: float = 1e-4, rho_max: float = 1e6, threshold: float = 0.3, seed: int = 0, layers: int = 1, activation: str = "tanh", normalise: bool = False, neighbours: int = 0, holdout: float = 0.0, cutoff: float = 1.0, mask: np.ndarray | None = None):
        super().__init__(hidden, lambda1, max_iter, rounds, rate, batch, h_tol, rho_max, threshold, seed)
        if activation not in ACTIVATIONS:
            raise ValueError(f"activation is one of {sorted(ACTIVATIONS)}")
        self.layers, self.activation, self.normalise, self.neighbours, self.holdout, self.cutoff, self.mask = layers, activation, normalise, neighbours, holdout, cutoff, mask

    def shapes(self, d: int) -> dict[str, tuple]:
        return network_shapes(d, self.hidden, self.layers) | {"b_log": (d,)}

    @staticmethod
    def constraint(w: np.ndarray) -> tuple[float, np.ndarray]:
        e = matrix_exponential(w)
        return np.trace(e, axis1=-2, axis2=-1) - w.shape[-1], np.swapaxes(e, -1, -2)

    def paths(self, p: dict[str, Value], d: int) -> Value:
        """(cause, variable)."""
        way = absolute(p["a0"]).swap(-3, -2)
        for k in range(1, self.layers):
            way = way @ absolute(p[f"a{k}"])
        every = (way @ absolute(p["out"])).reshape(*way.shape[:-3], d, d).swap()
        if self.normalise:
            every = every / (every.sum(axis=-2, keepdims=True) + 1e-8)
        return every * self.off(d)

    def loss(self, p, data, rho, alpha, rng, share=None) -> Value:
        d = data.shape[-1]
        gap = per_variable(p, data, self.off(d), self.layers, self.activation) - data
        likelihood = (p["b_log"] + (gap * gap * shares(data, share)).sum(axis=-2) * 0.5 * exp(p["b_log"] * -2.0)).sum()
        w = self.paths(p, d)
        return likelihood + self.penalty(w, rho, alpha) + w.sum() * (self.lambda1 * (rho > 0))

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        return self.paths(self.parameters(d).values(x), d).x

    def strengths(self, rows: DataFrame, columns: list[str], x: np.ndarray) -> np.ndarray:
        from causeway.operators.lowrank import batch_totals

        d = len(columns)

        def slopes(data: np.ndarray) -> np.ndarray:
            p = self.parameters(d).values(x)
            act, out = ACTIVATIONS[self.activation], np.zeros((d, d))
            a = p["a0"].x * self.off(d)[:, :, None]
            h = np.einsum("ni,ijm->jnm", data, a) + p["b_0"].x
            inputs = [h]
            for k in range(1, self.layers):
                inputs.append(act(inputs[-1]).x @ p[f"a{k}"].x + p[f"b_{k}"].x)
            back = np.broadcast_to(np.swapaxes(p["out"].x, 1, 2), inputs[-1].shape)
            for k in reversed(range(self.layers)):
                v = Value(inputs[k])
                y = act(v)
                back = y.back[0][1](back)  # times the activation's slope
                if k:
                    back = back @ np.swapaxes(p[f"a{k}"].x, 1, 2)
            out += np.abs(np.einsum("ijm,jnm->nij", a, back)).sum(axis=0)
            return np.append(out.ravel(), len(data))

        sums = batch_totals(rows, slopes, d * d + 1, 512)
        return sums[:-1].reshape(d, d) / max(sums[-1], 1)

    def allowed(self, rows: DataFrame, columns: list[str]) -> np.ndarray | None:
        if not self.neighbours:
            return None
        return preselected(rows, columns, self.neighbours, self.seed)

    def pruned(self, df: DataFrame, columns: list[str], graph: np.ndarray) -> np.ndarray:
        from causeway.plans.cam import SplineMoments, prune_by_curves

        return graph if self.cutoff >= 1 else prune_by_curves(SplineMoments(df, columns), graph, self.cutoff)


def preselected(rows: DataFrame, columns: list[str], most: int, seed: int = 0, trees: int = 20, depth: int = 5, share: float = 0.75) -> np.ndarray:
    """(i, j) is 1 where i may be a cause of j: its importance in a forest of regression trees for j is at least `share` of the mean one,
    and among the `most` largest. Spark grows the trees by histograms that its tasks add up."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    d = len(columns)
    out = np.zeros((d, d))
    plain = rows.select(*[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(columns)])
    for j in range(d):
        others = [i for i in range(d) if i != j]
        data = VectorAssembler(inputCols=[f"v{i}" for i in others], outputCol="features").transform(plain)
        forest = RandomForestRegressor(featuresCol="features", labelCol=f"v{j}", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird" if d > 4 else "all", seed=seed).fit(data)
        weight = forest.featureImportances.toArray()
        for k in np.argsort(-weight, kind="stable")[:most]:
            out[others[k], j] = float(weight[k] >= share * weight.mean())
    return out


@learner
class MCSL(_Tape):
    """Masked networks: every variable's network sees the others through a 0/1 mask that is drawn anew for every batch.

    The mask is sigmoid((logit + logistic noise) / temperature), so gradients pass through the draw; the temperature
    falls from start_temperature to temperature over the steps of the multiplier method. model: nn, or qr for
    regressions on the variables and their squares.
    """

    def __init__(self, hidden: int = 8, lambda1: float = 5e-3, max_iter: int = 8, rounds: int = 6, rate: float = 0.03, batch: int = 64, h_tol: float = 1e-4, rho_max: float = 1e6, threshold: float = 0.5, seed: int = 0, model: str = "nn", layers: int = 1, activation: str = "leaky_relu", temperature: float = 0.2, start_temperature: float = 1.0, mask: np.ndarray | None = None):
        super().__init__(hidden, lambda1, max_iter, rounds, rate, batch, h_tol, rho_max, threshold, seed)
        if model not in ("nn", "qr") or activation not in ACTIVATIONS:
            raise ValueError("model is nn or qr")
        self.model, self.layers, self.activation, self.temperature, self.start_temperature, self.mask = model, layers, activation, temperature, start_temperature, mask
        self.heat = start_temperature

    constraint = staticmethod(acyclicity)

    def begin(self, step: int) -> None:
        self.heat = max(self.temperature, self.start_temperature * (self.temperature / self.start_temperature) ** (step / max(1, self.max_iter - 2)))

    def shapes(self, d: int) -> dict[str, tuple]:
        effects = network_shapes(d, self.hidden, self.layers) if self.model == "nn" else {"line": (d, d), "bow": (d, d), "b_out": (d,)}
        return {"logit": (d, d)} | effects

    scale = {"logit": 0.01, "line": 0.1, "bow": 0.1}

    def loss(self, p, data, rho, alpha, rng, share=None) -> Value:
        *many, _, d = data.shape
        u = rng.uniform(1e-6, 1 - 1e-6, (*many, d, d))
        drawn = sigmoid((p["logit"] + np.log(u / (1 - u))) * (1 / self.heat)) * self.off(d)
        if self.model == "nn":
            out = per_variable(p, data, drawn, self.layers, self.activation)
        else:
            out = Value(data) @ (p["line"] * drawn) + Value(data**2) @ (p["bow"] * drawn) + across(p["b_out"])
        gap = out - data
        chance = sigmoid(p["logit"] * (1 / self.heat)) * self.off(d)
        return (gap * gap * shares(data, share)).sum() * 0.5 + self.penalty(chance, rho, alpha) + chance.sum() * (self.lambda1 * (rho > 0))

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.part(x, d, "logit") / self.heat, -50, 50))) * self.off(d)


@learner
class NotearsMLP(_Tape):
    """NOTEARS with networks of several hidden layers; an edge's strength is the norm of the weights from cause to first layer."""

    def __init__(self, hidden: int = 8, lambda1: float = 0.01, max_iter: int = 6, rounds: int = 6, rate: float = 0.02, batch: int = 64, h_tol: float = 1e-4, rho_max: float = 1e6, threshold: float = 0.3, seed: int = 0, layers: int = 2, activation: str = "sigmoid", mask: np.ndarray | None = None):
        super().__init__(hidden, lambda1, max_iter, rounds, rate, batch, h_tol, rho_max, threshold, seed)
        if activation not in ACTIVATIONS:
            raise ValueError(f"activation is one of {sorted(ACTIVATIONS)}")
        self.layers, self.activation, self.mask = layers, activation, mask

    scale = {"a0": 0.1}
    constraint = staticmethod(acyclicity_power)

    def shapes(self, d: int) -> dict[str, tuple]:
        return network_shapes(d, self.hidden, self.layers)

    def loss(self, p, data, rho, alpha, rng, share=None) -> Value:
        d = data.shape[-1]
        gap = per_variable(p, data, self.off(d), self.layers, self.activation) - data
        w = root((p["a0"] * p["a0"]).sum(axis=-1)) * self.off(d)
        decay = sum(((p[k] * p[k]).sum() for k in p if k[0] == "o" or (k[0] == "a" and k != "a0")), Value(0.0)) * (0.5e-3 * (rho > 0))
        return (gap * gap * shares(data, share)).sum() * 0.5 + self.penalty(w, rho, alpha) + w.sum() * (self.lambda1 * (rho > 0)) + decay

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        a = self.part(x, d, "a0")
        return np.sqrt((a * a).sum(axis=2)) * self.off(d)


def shared(p: dict[str, Value], name: str, v: Value | np.ndarray) -> Value:
    """One network for all variables, which are rows of v, with a straight way beside its hidden layer. No derivatives by an array."""
    by_v = isinstance(v, Value)
    parts = [p[f"{name}_in"], p[f"b_{name}_in"], p[f"{name}_out"], p[f"{name}_line"], p[f"b_{name}_out"]]
    into, b_in, out, line, b_out = (part.x for part in parts)
    m, size = out.shape[-2], into.shape[-2]
    first = np.concatenate([turned(into), b_in[..., None]], axis=-1)
    last = np.concatenate([turned(out), turned(line), b_out[..., None]], axis=-1)
    y, back = one_network(first, last, turned(v.x if by_v else v))

    def each(g: np.ndarray) -> list[np.ndarray]:
        f, t, g_v = back(turned(g), by_v)
        return [turned(f[..., :size]), f[..., size], turned(t[..., :m]), turned(t[..., m:-1]), t[..., -1], *([turned(g_v)] if by_v else [])]

    return together(turned(y), [*parts, *([v] if by_v else [])], each)


def shared_shapes(name: str, size: int, hidden: int, to: int) -> dict[str, tuple]:
    return {f"{name}_in": (size, hidden), f"b_{name}_in": (hidden,), f"{name}_out": (hidden, to), f"{name}_line": (size, to), f"b_{name}_out": (to,)}


@learner
class DAGGNN(_Tape):
    """A variational autoencoder: one network for all variables codes them, the code less what the graph explains of
    it is the latent variable, and the way back through the graph and a second network gives the variables again.

    form: mlp, or sem, whose coder and decoder are the variables themselves. The latent variable's deviation is learned for each variable (noise: where
    it starts), against a prior of deviation 1. Draws come from the round and the task.
    """

    constraint = staticmethod(acyclicity)
    scale = {"graph": 0.01, "code_out": 0.1, "back_out": 0.1}

    def __init__(self, hidden: int = 8, lambda1: float = 0.005, max_iter: int = 6, rounds: int = 6, rate: float = 0.02, batch: int = 64, h_tol: float = 1e-4, rho_max: float = 1e6, threshold: float = 0.3, seed: int = 0, noise: float = 0.3, form: str = "mlp", learn_noise: bool = True, mask: np.ndarray | None = None):
        super().__init__(hidden, lambda1, max_iter, rounds, rate, batch, h_tol, rho_max, threshold, seed)
        if form not in ("mlp", "sem"):
            raise ValueError("form is mlp or sem")
        self.noise, self.form, self.learn_noise, self.mask = noise, form, learn_noise, mask

    def shapes(self, d: int) -> dict[str, tuple]:
        nets = shared_shapes("code", 1, self.hidden, 1) | shared_shapes("back", 1, self.hidden, 1) if self.form == "mlp" else {}
        return {"graph": (d, d), "b_log": (d,)} | nets

    def start(self, d: int, rng: np.random.Generator) -> np.ndarray:
        parameters = self.parameters(d)
        p = parameters.values(parameters.start(rng, self.scale))
        p["b_log"].x[:] = np.log(self.noise)
        for name in ("code_line", "back_line"):
            if name in p:
                p[name].x[:] = 1.0
        return np.concatenate([v.x.ravel() for v in p.values()])

    def loss(self, p, data, rho, alpha, rng, share=None) -> Value:
        *many, n, d = data.shape
        a, share = p["graph"] * self.off(d), shares(data, share)
        less, way = np.eye(d) - a, inverse(np.eye(d) - a)
        code = Value(data) if self.form == "sem" else shared(p, "code", data.reshape(*many, n * d, 1)).reshape(*many, n, d)
        z = code @ less
        log = p["b_log"] if self.learn_noise else Value(np.full(d, np.log(self.noise)))
        drawn = z + across(exp(log)) * rng.normal(size=(*many, n, d))
        mixed = drawn @ way
        out = mixed if self.form == "sem" else shared(p, "back", mixed.reshape(*many, n * d, 1)).reshape(*many, n, d)
        gap = out - data
        apart = (z * z * share).sum() * 0.5 + (exp(log * 2.0) * 0.5 - log).sum()
        return (gap * gap * share).sum() * 0.5 + apart + self.penalty(a, rho, alpha) + absolute(a).sum() * (self.lambda1 * (rho > 0))

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        return self.part(x, d, "graph") * self.off(d)


@learner
class VectorAutoencoder(_Tape):
    """The graph autoencoder for variables that are arrays of numbers, all of the same length; plain numbers are arrays of one.

    code: length of a variable's code. Weights are taken relative to the largest before the threshold.
    """

    relative = True
    constraint = staticmethod(acyclicity)
    scale = {"graph": 0.1}

    def __init__(self, hidden: int = 8, lambda1: float = 0.01, max_iter: int = 6, rounds: int = 6, rate: float = 0.02, batch: int = 64, h_tol: float = 1e-4, rho_max: float = 1e6, threshold: float = 0.3, seed: int = 0, code: int = 1, mask: np.ndarray | None = None):
        super().__init__(hidden, lambda1, max_iter, rounds, rate, batch, h_tol, rho_max, threshold, seed)
        self.code, self.mask, self.length = code, mask, 1

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        arrays = [c for c, kind in df.select(*[F.col(f"`{c}`") for c in columns]).dtypes if kind.startswith("array")]
        if arrays and len(arrays) < len(columns):
            raise ValueError("either all variables are arrays or none is")
        if not arrays:
            self.length = 1
            return super().learn(df, columns)
        ends = df.agg(*[f(F.size(F.col(f"`{c}`"))) for c in columns for f in (F.min, F.max)]).first()
        if len(set(ends)) != 1:
            raise ValueError("all arrays must have one length")
        self.length = int(ends[0])
        flat = df.select(*[F.element_at(F.col(f"`{c}`"), k + 1).cast("double").alias(f"{c}~{k}") for c in columns for k in range(self.length)])
        found = super().learn(flat, flat.columns)
        return Graph(list(columns), found.matrix, found.weights, found.notes)

    def variables(self, columns: list[str]) -> int:
        return len(columns) // self.length

    def width(self, data: np.ndarray) -> int:
        return data.shape[-1] // self.length

    def shapes(self, d: int) -> dict[str, tuple]:
        return {"graph": (d, d)} | shared_shapes("code", self.length, self.hidden, self.code) | shared_shapes("back", self.code, self.hidden, self.length)

    def loss(self, p, data, rho, alpha, rng, share=None) -> Value:
        *many, n, _ = data.shape
        d = self.width(data)
        a = p["graph"] * self.off(d)
        code = shared(p, "code", data.reshape(*many, n * d, self.length)).reshape(*many, n, d, self.code)
        mixed = code.swap().reshape(*many, n * self.code, d) @ a  # one product a shard, not one a row
        mixed = mixed.reshape(*many, n, self.code, d).swap().reshape(*many, n * d, self.code)
        gap = shared(p, "back", mixed).reshape(*data.shape) - data
        return (gap * gap * shares(data, share)).sum() * 0.5 + self.penalty(a, rho, alpha) + absolute(a).sum() * (self.lambda1 * (rho > 0))

    def weights(self, x: np.ndarray, d: int) -> np.ndarray:
        return self.part(x, d, "graph") * self.off(d)

