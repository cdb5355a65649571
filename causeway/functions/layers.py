"""Layers of small networks and their derivatives, for several cases at once (axes before the last two).

Rows lie along the last axis and units before it: sums over rows or units are products of matrices, and what is
done unit by unit runs along the rows, in place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by the exponential, which numpy has in a third of tanh's time; absolute error under 1e-15."""
    with np.errstate(over="ignore"):
        x += x
        np.exp(x, out=x)
    x += 1
    np.divide(-2.0, x, out=x)
    x += 1
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    with np.errstate(over="ignore"):
        np.negative(x, out=x)
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0, out=x)


def leaky_relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.25 * x, out=x)


#: Activations in place, and their slopes by their results.
UNITS: dict[str, tuple[Callable, Callable]] = {
    "tanh": (tanh, lambda y: 1 - y * y),
    "sigmoid": (sigmoid, lambda y: y * (1 - y)),
    "relu": (relu, lambda y: (y > 0) * 1.0),
    "leaky_relu": (leaky_relu, lambda y: np.where(y > 0, 1, 0.25)),
}


def turned(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def one_network(first: np.ndarray, last: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, Callable]:
    """last @ [tanh(first @ [v; 1]); v; 1], and what gives, for its derivative, those by first, last and (None if not asked for) v."""
    m, k = first.shape[-2], v.shape[-2]
    seen = np.empty((*v.shape[:-2], k + 1, v.shape[-1]))
    seen[..., :k, :], seen[..., k, :] = v, 1
    hidden = tanh(first @ seen)
    out, line = last[..., :m], last[..., m:]

    def back(g: np.ndarray, by_v: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        inner = hidden * hidden
        np.subtract(1, inner, out=inner)
        inner *= turned(out) * g if g.shape[-2] == 1 else turned(out) @ g
        by_last = np.concatenate([g @ turned(hidden), g @ turned(seen)], axis=-1)
        return inner @ turned(seen), by_last, turned(first[..., :k]) @ inner + turned(line[..., :k]) @ g if by_v else None

    return out @ hidden + line @ seen, back


def networks(data: np.ndarray, a: np.ndarray, b: np.ndarray, deeper: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray, b_out: np.ndarray, units: str) -> tuple[np.ndarray, Callable]:
    """Every variable's own network over the others: (n, d) of (n, d), and what gives the derivatives by a, b, deeper, out and b_out.

    a: (cause, variable, unit), b: (variable, unit), deeper: pairs of (variable, unit, unit) and (variable, unit),
    out: (variable, unit), b_out: (variable,).
    """
    *many, n, d = data.shape
    m = a.shape[-1]
    act, slope = UNITS[units]
    seen = np.empty((*many, d + 1, n))
    seen[..., :d, :], seen[..., d, :] = turned(data), 1
    first = np.concatenate([turned(a.reshape(*many, d, d * m)), b.reshape(*many, d * m, 1)], axis=-1)
    hidden = [act(first @ seen).reshape(*many, d, m, n)]
    for w, bias in deeper:
        h = turned(w) @ hidden[-1]
        h += bias[..., None]
        hidden.append(act(h))
    y = (out[..., None, :] @ hidden[-1]).reshape(*many, d, n) + b_out[..., None]

    def back(g: np.ndarray) -> tuple:
        g = np.ascontiguousarray(turned(g))
        ones, found = np.ones((n, 1)), []
        g_out = (hidden[-1] @ g[..., None])[..., 0]
        inner = out[..., None] * g[..., None, :]
        inner *= slope(hidden[-1])
        for (w, _), h in zip(reversed(deeper), reversed(hidden[:-1]), strict=True):
            found.append((h @ turned(inner), (inner @ ones)[..., 0]))
            inner = w @ inner
            inner *= slope(h)
        g_first = inner.reshape(*many, d * m, n) @ turned(seen)
        g_a = turned(g_first[..., :d]).reshape(*many, d, d, m)
        return g_a, g_first[..., d].reshape(*many, d, m), found[::-1], g_out, (g @ ones)[..., 0]

    return turned(y), back
