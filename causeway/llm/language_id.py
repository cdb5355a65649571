"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
fixed-length window and classified by a softmax. A text is all of its windows;
its language is the one with the highest mean log-probability. For inference the
embedding and the filters are multiplied out into tables over pairs of bytes, so
a window costs a few table look-ups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .frames import chunks, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class ByteNet:
    """languages; embedding (256 x e); filters[w] (w x e x f) and bias[w] (f); out (all f x languages), out_bias."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Sums of filter outputs by the pair of bytes at shifts 0, 2 and 4, for the filters that reach there."""
        made = []
        for shift in range(0, max(WIDTHS), 2):
            parts = []
            for w, kernel in zip(WIDTHS, self.filters, strict=True):
                if w <= shift:
                    continue
                one = self.embedding @ kernel[shift]
                two = self.embedding @ kernel[shift + 1] if w > shift + 1 else np.zeros_like(one)
                parts.append((one[None, :, :] + two[:, None, :]).reshape(65536, -1))
            made.append(np.ascontiguousarray(np.concatenate(parts, axis=1), dtype=np.float32))
        made[0] += np.concatenate(self.bias).astype(np.float32)
        return made

    def pooled(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Max over the positions of each window, after ReLU."""
        n = windows.shape[1] - max(WIDTHS)
        pairs = windows[:, :-1].astype(np.int32) + (windows[:, 1:].astype(np.int32) << 8)
        sums = tables[0].take(pairs[:, :n], axis=0)
        for k, table in enumerate(tables[1:], 1):
            sums[:, :, -table.shape[1] :] += table.take(pairs[:, 2 * k : 2 * k + n], axis=0)
        return np.maximum(sums.max(axis=1), 0)

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fixed-length windows of the texts (zero-padded, with a margin), the text and the filled share of each."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // WINDOW)
    raw = np.zeros((int(counts.sum()) + 1) * WINDOW, dtype=np.uint8)
    at = 0
    for t, c in zip(texts, counts, strict=True):
        raw[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(c) * WINDOW
    of = np.repeat(np.arange(len(texts)), counts)
    filled = np.full(len(of), WINDOW)
    last = np.cumsum(counts)[counts > 0] - 1
    filled[last] = (sizes - (counts - 1) * WINDOW)[counts > 0]
    windows = np.zeros((len(of), WINDOW + max(WIDTHS)), dtype=np.uint8)
    windows[:, :WINDOW] = raw[: len(of) * WINDOW].reshape(-1, WINDOW)
    return windows, of, filled / WINDOW


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], embed: int = 8, filters: int = 12, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Adam on the cross-entropy of single windows; gradients flow to each filter's strongest place only."""
    rng = np.random.default_rng(seed)
    net = ByteNet(
        languages,
        rng.normal(0, 0.5, (256, embed)),
        [rng.normal(0, (2 / (w * embed)) ** 0.5, (w, embed, filters)) for w in WIDTHS],
        [np.zeros(filters) for _ in WIDTHS],
        rng.normal(0, 0.2, (filters * len(WIDTHS), len(languages))),
        np.zeros(len(languages)),
    )
    if not len(windows):
        return net
    params = [net.embedding, *net.filters, *net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    n_pos = WINDOW - 1
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y = windows[at].astype(np.int64), labels[at]
            e = net.embedding[x]
            b = len(x)
            picks, pooled = [], []
            for w, kernel, bias in zip(WIDTHS, net.filters, net.bias, strict=True):
                z = bias + sum(e[:, j : j + n_pos] @ kernel[j] for j in range(w))
                k = z.argmax(axis=1)
                picks.append(k)
                pooled.append(np.maximum(np.take_along_axis(z, k[:, None, :], axis=1)[:, 0], 0))
            hidden = np.concatenate(pooled, axis=1)
            p = np.exp(net.log_probabilities(hidden))
            p[np.arange(b), y] -= 1
            p /= b
            grads_out, grads_bias = hidden.T @ p, p.sum(axis=0)
            back = (p @ net.out.T) * (hidden > 0)
            g_embed, g_filters, g_biases = np.zeros_like(net.embedding), [], []
            for i, (w, kernel) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = back[:, i * filters : (i + 1) * filters]
                g_kernel = np.zeros_like(kernel)
                for j in range(w):
                    symbols = np.take_along_axis(x, picks[i] + j, axis=1)
                    near = net.embedding[symbols]  # b x f x e
                    g_kernel[j] = np.einsum("bf,bfe->ef", g, near)
                    np.add.at(g_embed, symbols, g[:, :, None] * kernel[j].T[None])
                g_filters.append(g_kernel)
                g_biases.append(g.sum(axis=0))
            t += 1
            for k, (param, grad) in enumerate(zip(params, [g_embed, *g_filters, *g_biases, grads_out, grads_bias], strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad**2
                param -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_texts: int = 600, most_windows: int = 6, most_languages: int = 512) -> ByteNet:
    """A network from the texts and languages of docs.

    At most most_texts different texts a language (those with the least hash of
    the text) and most_windows windows of each, evenly spaced over the whole text,
    are trained on, and windows of a language with few are repeated; copies of a text
    count once, and rows without text or language are left out. More than most_languages languages are refused.
    """
    known = docs.filter(F.col(f"`{lang_col}`").isNotNull() & (F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) > 0)).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    texts = known.select("lang", F.xxhash64("text").alias("hash")).distinct()
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return train(np.zeros((0, 0)), np.zeros(0), [])
    # A hash range a little wider than needed keeps the ranking small whatever a language's share.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * most_texts / n)))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    few = known.withColumn("place", place).filter(F.col("place") < share[F.col("lang")] * (1 << 30)).distinct()
    few = few.withColumn("k", F.row_number().over(W.Window.partitionBy("lang").orderBy("place", "text"))).filter(F.col("k") <= most_texts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            windows, of, filled = cut_windows(texts_of(batch.column(2)))
            place_in = np.arange(len(of)) - np.searchsorted(of, of)
            number = np.bincount(of, minlength=batch.num_rows)[of]
            use = (place_in * most_windows // np.maximum(number, 1) != (place_in - 1) * most_windows // np.maximum(number, 1)) & ((filled > 0.1) | (number == 1))
            cut = [windows[use & (of == i)].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary())], ["lang", "k", "windows"])

    rows = few.select("lang", "k", F.col("text").cast("string").alias("text")).mapInArrow(sample, "lang string, k int, windows binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["k"]))
    languages = sorted(counts)
    width = cut_windows([b""])[0].shape[1]
    parts = [np.frombuffer(r["windows"], dtype=np.uint8).reshape(-1, width) for r in rows]
    label = np.repeat([languages.index(r["lang"]) for r in rows], [len(x) for x in parts])
    # Windows of a language with few are repeated, so that each has a quarter of the most at least.
    each = np.bincount(label, minlength=len(languages))
    at = np.concatenate([np.resize(np.flatnonzero(label == k), max(n, -(-int(each.max()) // 4))) for k, n in enumerate(each)])
    return train(np.concatenate(parts)[at], label[at], languages)


def identify_language(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; all windows of the whole text count.

    A null text, or one without a letter, is `und` with score 0, and so is all
    text if the network knows no language. Of languages that are equally likely the
    first by name is taken. Very long texts are read whole, in windows. Rows given
    twice, and rows without an id, are each given back; an empty table gives an empty
    one. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net.languages else []
        for batch in chunks(batches, "text"):
            texts = texts_of(batch.column(1))
            lang, score = predict_texts(net, tables, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER[np.frombuffer(text, dtype=np.uint8)].any()) or any(c.isalpha() for c in text.decode("utf-8", "replace") if c > "\x7f" and c != "�")


def predict_texts(net: ByteNet, tables: list[np.ndarray], texts: list[bytes], batch: int = 128) -> tuple[list[str], list[float]]:
    if not net.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    windows, of, filled = cut_windows(texts)
    total = np.zeros((len(texts), len(net.languages)))
    for i in range(0, len(of), batch):
        part = net.log_probabilities(net.pooled(windows[i : i + batch], tables)) * filled[i : i + batch, None]
        np.add.at(total, of[i : i + batch], part)
    mean = total / np.maximum(np.bincount(of, weights=filled, minlength=len(texts)), 1e-9)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    known = [has_letter(t) for t in texts]
    return [net.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
