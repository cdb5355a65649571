"""Near duplicates among vectors by a pivot-permutation index.

Some vectors serve as pivots. Every vector is described by its nearest pivots, the
nearest first, and enters their inverted lists. Two near vectors have most of their
nearest pivots in common, so pairs that share enough of them are retrieved from the
lists, and their cosines are computed. A pair is looked at in the list of its first
common pivot alone, so links are counted where they are found and never collected.

Equal vectors are one class with a count. Lists are kept by label. A list over a tile's
size is cut into tiles, each pair of which is one task's: a large group of near copies
costs products of matrices but no rows, as a tile returns a count for each class and the
branches of a forest for its components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import durable, partitions, releasing
from .kernels import mix
from .tiles import grouped, tiled
from .topk import usable

U64 = np.uint64
#: Nearest pivots of a vector, and how many of them a retrieved pair shares.
NEAREST, SHARED = 8, 2
#: Components of all pivots together: 16 MB as doubles.
PIVOT_ROOM = 1 << 21
TILE = 512
POSTED = "key long, pivot int, rep long, n long, nearest array<int>, vector {}"
FOUND = "rep long, other long, n long"


def apart(x: np.ndarray, most: float) -> np.ndarray:
    """The unit vectors, in their order, that have no cosine over `most` with one taken before."""
    taken = np.zeros(len(x), dtype=bool)
    for k in range(len(x)):
        taken[k] = not (x[:k][taken[:k]] @ x[k] > most).any()
    return x[taken]


def pivots_of(classes: DataFrame, least: float, most: int | None = None) -> dict[int, np.ndarray]:
    """Unit pivots by length of vector, out of the classes of smallest hash: twice the square root of all, 4096 and PIVOT_ROOM components at most.

    Pivots lie twice the angle of `least` apart, or that angle where too few do: of a
    group of near copies, however large, one is a pivot, so its members agree on the
    others. Lengths that get fewer than 2 * NEAREST pivots have none; all vectors of
    such a length and label are compared.
    """
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    take = most or max(2 * NEAREST, min(4096, 2 * math.isqrt(n), PIVOT_ROOM // max(longest or 1, 1)))
    share = min(2**63 - 1, int(2**64 * 8 * take / max(n, 1)) - 2**63)  # a hash range of some eight times as many: fewer rows are sorted
    rows = classes.withColumn("h", F.xxhash64("rep")).filter(F.col("h") <= share).orderBy("h", "rep").limit(take).select("vector").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for dim, v in by.items():
        x = unit(np.array(v, dtype=np.float64))
        tries = (apart(x, 2 * least * least - 1), apart(x, least))
        enough = [t for t in tries if len(t) >= 2 * NEAREST]
        if enough:
            out[dim] = enough[0]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) for each length of the column's vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def posted(classes: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """A row for each inverted list that a class enters.

    Two classes that share SHARED of their pivots share one besides the last of either by
    number, so the last list is spared. Without pivots all vectors of a length and label are one list (-1).
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                for at, x in rows_of(batch.column(3)):
                    dim = x.shape[1]
                    if dim in pivots:
                        score = unit(x) @ pivots[dim].T
                        near = np.argpartition(-score, NEAREST - 1, axis=1)[:, :NEAREST]
                        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1)
                        lists = np.sort(near, axis=1)[:, : NEAREST - SHARED + 1]
                    else:
                        near, lists = np.full((len(at), 1), -1), np.full((len(at), 1), -1)
                    each = np.repeat(np.arange(len(at)), lists.shape[1])
                    rows = batch.take(pa.array(at[each]))
                    nearest = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * near.shape[1], pa.int32()), pa.array(near[each].ravel(), pa.int32()))
                    pivot = lists.ravel()
                    key = mix(mix(rows.column(0).to_numpy().view(U64) + U64(dim)) + pivot.astype(np.int64).view(U64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pivot, pa.int32()), rows.column(1), rows.column(2), nearest, rows.column(3)], ["key", "pivot", "rep", "n", "nearest", "vector"])

    return classes.select("label", "rep", "n", "vector").mapInArrow(describe, POSTED.format(kind))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it reaches by the links i - j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root] != root).any():
            root = np.where(up, root[root], root)
    return root


def linked(x: np.ndarray, nearest: np.ndarray, pivot: int, tile: np.ndarray, least: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of a list's unit vectors that are retrieved in this list and whose cosine is `least` or more."""
    names, which = np.unique(nearest, return_inverse=True)
    has = np.zeros((len(x), len(names)), dtype=np.float32)
    has[np.arange(len(x))[:, None], which.reshape(nearest.shape)] = 1
    below = has[:, names < pivot]
    need = 1 if pivot < 0 else SHARED
    for a in range(0, len(x), block):
        b = min(a + block, len(x))
        shared = has[a:b] @ has[a:].T >= need
        if below.shape[1]:
            shared &= below[a:b] @ below[a:].T == 0
        shared &= (tile[a:b, None] < 0) | (tile[a:b, None] != tile[None, a:])
        i, j = np.nonzero(np.triu(shared, 1))
        if len(i) * 8 > shared.size:
            ok = (x[a:b] @ x[a:].T)[i, j] >= least
        else:
            ok = np.concatenate([np.zeros(0, dtype=bool), *(np.einsum("ij,ij->i", x[a + i[c : c + 8192]], x[a + j[c : c + 8192]]) >= least for c in range(0, len(i), 8192))])
        yield a + i[ok], a + j[ok]


def links(posts: DataFrame, least: float, tile: int, total: int) -> DataFrame:
    """FOUND rows: (rep, null, n) says how many vectors of other classes link with those of rep; (rep, other, 0) are links that join all components."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group, place in grouped(batches, rows=256):
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                near = part.column(part.schema.get_field_index("nearest"))
                # Keys are hashes: a list is told by its pivot and the length of its vectors, too.
                for at, x in rows_of(part.column(part.schema.get_field_index("vector"))):
                    every = part.take(pa.array(at))
                    for pivot in np.unique(pivots := every.column(1).to_numpy()).tolist():
                        own = np.flatnonzero(pivots == pivot)
                        if len(own) < 2:
                            continue
                        rows = every.take(pa.array(own))
                        rep, n = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                        nearest = np.stack(near.take(pa.array(at[own])).to_numpy(zero_copy_only=False))
                        count, root = np.zeros(len(own), dtype=np.int64), np.arange(len(own))
                        for i, j in linked(unit(x[own]), nearest, pivot, place[a:b][at[own]], least):
                            np.add.at(count, i, n[j])
                            np.add.at(count, j, n[i])
                            tied = np.flatnonzero(root != np.arange(len(own)))
                            root = forest(len(own), np.concatenate([tied, i]), np.concatenate([root[tied], j]))
                        some, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(own)))
                        other = pa.array([None] * len(some) + rep[root[tied]].tolist(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[some], rep[tied]])), other, pa.array(np.concatenate([count[some], 0 * tied]))], ["rep", "other", "n"])

    return tiled(posts, "key", F.xxhash64("rep"), tile, total).mapInArrow(releasing(search), FOUND)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tile: int = TILE, most_pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors of its label with a cosine of `least` or more, and the smallest id that links reach.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null label or id, link with nothing: no links, their own component, kept.
    Rows given twice are vectors that link. Vectors of different lengths do not link.
    The index finds almost all links (recall is measured in the tests), and none below
    `least`. An empty table gives an empty one; other columns are not read.
    """
    kind = vectors.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("given"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    able = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("given").isNotNull() & F.col("vec_id").isNotNull()
    # Labels and vectors are told by 128 bits of two hashes; a label alone by 64.
    rows = rows.select("vec_id", F.when(able, F.struct(F.xxhash64("given", "vector").alias("h"), F.xxhash64(F.lit(1), "vector", "given").alias("g"))).alias("same"), F.xxhash64("given").alias("label"), "vector")
    classes = durable(rows.filter("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    found = durable(links(posted(classes, pivots_of(classes, least, most_pivots), kind), least, tile, NEAREST * classes.count()))
    counts = found.filter("other is null").groupBy("rep").agg(F.sum("n").alias("found"))
    components = connected_components(found.filter("other is not null").select("rep", "other"))
    each = classes.select("same", "rep", "n").join(counts, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    each = durable(each.select("same", F.col("n").alias("members"), (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    # A class with a large share of all rows meets them by a broadcast; there are few such.
    hub = max(1000, rows.count() // (8 * partitions(vectors.sparkSession)))
    small = rows.select("vec_id", "same")
    hot = F.broadcast(each.filter(F.col("members") > hub))
    rest = small.join(hot.select("same"), "same", "left_anti").join(each.filter(F.col("members") <= hub), "same", "left")
    out = small.join(hot, "same").unionByName(rest)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
