"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed with numpy in Spark tasks. The trees are
trained on the driver from a bounded sample of labelled rows, kept as complete
binary trees in flat arrays, and traversed for whole batches of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import chunks, releasing, texts_of
from .kernels import IS_SPACE, LOWER, Words

STATISTICS = (
    "log_bytes log_words mean_word longest_word upper letters digits beyond_ascii stops commas symbols bars marks_at_end distinct_words top_word repeats_in_a_row words_a_line distinct_lines entropy longest_run".split()
)

_CLASS = np.zeros((256, 7), dtype=bool)
_CLASS[65:91, 0] = True  # capitals
_CLASS[[*range(65, 91), *range(97, 123)], 1] = True  # letters
_CLASS[48:58, 2] = True  # digits
_CLASS[128:, 3] = True  # bytes beyond ASCII
_CLASS[[ord(c) for c in ".!?"], 4] = True
_CLASS[[ord(c) for c in ",;:"], 5] = True
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"], 6] = True
_ENDS = ~_CLASS[:, 1] & ~_CLASS[:, 2] & ~_CLASS[:, 3]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    w = Words(texts)
    n_docs = len(texts)
    size = np.maximum(w.doc_ends - w.doc_starts - 1, 0)
    n_words = w.counts
    doc = w.doc()
    length = w.ends - w.starts
    some, words = np.maximum(size, 1).astype(float), np.maximum(n_words, 1).astype(float)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([w.doc_starts, w.doc_ends[-1:]])])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n_docs)

    share = {k: total(_CLASS[:, k][w.raw]) / some for k in range(7)}
    bars = total(w.raw == ord("|")) / words
    longest = np.zeros(n_docs)
    np.maximum.at(longest, doc, length)
    marks = per_word(_ENDS[w.raw[w.ends - 1]] & ~np.isin(w.raw[w.ends - 1], np.frombuffer(b".,", dtype=np.uint8)))
    lowered = Words.__new__(Words)
    lowered.__dict__.update(w.__dict__)
    lowered.raw = LOWER[w.raw]
    hashes = lowered.hashes()
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(fresh)
    top = np.zeros(n_docs)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(h))))
    breaks = w.raw == 10
    lines = np.maximum(total(breaks), 1)  # each document ends with one break
    line_no = np.concatenate([[0], np.cumsum(breaks)[:-1]])
    of_word = line_no[w.starts] if len(w.starts) else np.zeros(0, dtype=np.int64)
    line_doc = np.repeat(np.arange(n_docs), total(breaks))
    line_hash = np.zeros(int(breaks.sum()), dtype=np.uint64)
    np.add.at(line_hash, of_word, hashes)
    order = np.lexsort((line_hash, line_doc))
    lh, ld = line_hash[order], line_doc[order]
    new = np.ones(len(lh), dtype=bool)
    new[1:] = (lh[1:] != lh[:-1]) | (ld[1:] != ld[:-1])
    distinct_lines = np.bincount(ld[new], minlength=n_docs) / lines
    entropy, run = np.zeros(n_docs), np.zeros(n_docs)
    change = np.flatnonzero(np.concatenate([[True], w.raw[1:] != w.raw[:-1]]))
    run_doc = np.searchsorted(w.doc_ends, change, side="right")
    np.maximum.at(run, run_doc, np.where(IS_SPACE[w.raw[change]], 0, np.diff(np.append(change, len(w.raw)))))
    for i in range(0, n_docs, 1024):  # a table of 256 counts for each of some documents at a time
        last = min(n_docs, i + 1024)
        of = np.repeat(np.arange(last - i), (w.doc_ends - w.doc_starts)[i:last]) * 256
        counts = np.bincount(of + w.raw[w.doc_starts[i] : w.doc_ends[last - 1]], minlength=(last - i) * 256).reshape(-1, 256)
        counts[:, 10] -= 1  # the break after each document
        p = counts / some[i:last, None]
        entropy[i:last] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    columns = [
        np.log1p(size), np.log1p(n_words), per_word(length) / words, longest, share[0], share[1], share[2], share[3], share[4], share[5], share[6],
        bars, marks / words, np.bincount(d[at], minlength=n_docs) / words, top / words, per_word(again) / words, n_words / lines, distinct_lines, entropy, np.minimum(run, 255),
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Boosted complete binary trees: feature and cut of every inner node, value of every leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Fit with logistic loss; splits are searched in histograms of quantile bins."""
    n, f = x.shape
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        p = float(y.mean()) if n else 0.5
        return Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    out = np.full(n, base)
    features, cuts, leaves = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    flat = binned + np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (f * bins) + flat).ravel()
            size = width * f * bins
            sums = [np.cumsum(np.bincount(at, weights=np.repeat(v, f), minlength=size).reshape(width, f, bins), axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    features[t, first + k], cuts[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t][node]] > cuts[t][node])
        k = node - inner
        step = -rate * np.bincount(k, weights=g, minlength=inner + 1) / (np.bincount(k, weights=h, minlength=inner + 1) + ridge)
        leaves[t] = step
        out += step[k]
    return Trees(features, cuts, leaves, base)


def _map_statistics(rows: DataFrame, finish, schema: str) -> DataFrame:
    """rows: doc columns and the text last; finish: makes the output columns after the first ones."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = finish(statistics(texts_of(batch.column(batch.num_columns - 1))))
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for _, c in found)], [*names, *(k for k, _ in found)])

    return rows.mapInArrow(releasing(measure), schema)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = 20_000) -> Trees:
    """Trees from labelled rows of docs.

    At most most_labelled rows of labels are used, those with the least hash of
    their id, so the sample is the same at every run; both tables otherwise may
    be of any size. Rows without id or label are left out, labels given twice count
    once, and so does a labelled id that docs have several times, with the text of
    the least hash; so the driver gets most_labelled rows of statistics at most. Whole
    texts are measured, null and empty ones as empty, very long ones too. Where no
    label meets a row the trees give 0.5 to all, and where labels are all the same
    they give its share. Other columns are not read.
    """
    few = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("labelled_id"), (F.col(f"`{label_col}`") >= 1).cast("int").alias("label"))
    few = few.distinct().orderBy(F.xxhash64("labelled_id"), "labelled_id", "label").limit(most_labelled)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = slim.join(F.broadcast(few), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "label", F.xxhash64("text").alias("hash"), "text")
    measured = _map_statistics(rows, lambda x: [(n, x[:, j]) for j, n in enumerate(STATISTICS)], "labelled_id long, label int, hash long, " + ", ".join(f"{n} double" for n in STATISTICS))
    one = measured.groupBy("labelled_id", "label").agg(F.min(F.struct("hash", *STATISTICS)).alias("least"))
    table = one.select("label", *[F.col(f"least.{n}").alias(n) for n in STATISTICS]).toPandas()
    table = table.sort_values([*STATISTICS, "label"])
    return boost(table[list(STATISTICS)].to_numpy(), table["label"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row's whole text, however long.

    Null and empty texts are scored as empty ones. Rows given twice, and rows without
    an id, are each given back; equal texts score alike. An empty table gives an empty
    one. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return _map_statistics(rows, lambda x: [("score", model.score(x))], "doc_id long, score double")


def filter_quality(docs: DataFrame, model: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose text scores at least `least`.

    Null and empty texts are scored as empty ones, very long ones whole. Rows given
    twice stay or go together, a score of just `least` stays, and an empty table gives
    an empty one.
    """
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in chunks(iter([batch]), text_col):
                good = model.score(statistics(texts_of(part.column(at)))) >= least
                yield part.filter(pa.array(good))

    return docs.mapInArrow(releasing(keep), schema)


def held_out(id_col: Column, remainder: int, of: int) -> Column:
    """crc32 of the id as text, modulo `of`, is `remainder`; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % of == remainder, F.lit(False))
