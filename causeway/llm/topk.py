"""Exact top-k search by distributed histogram selection.

Candidates are packed into blocks that stay where they are. Queries are taken in
chunks of bounded size; each chunk is broadcast and meets every block of
candidates as matrix products. Each task sums a histogram of every query's scores,
and the sums over all tasks say in which bin the kth score lies. A second pass
keeps the scores from that bin up. Histograms of what it kept refine the bin until
it is narrow or holds few scores; what lies below is filtered out, and ties are
broken by id.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .frames import durable, partitions, shared_folder

BINS = 256
PACKED = "part int, ids binary, dim int, vectors binary"
MOST = 2**63 - 1
U64 = np.uint64


def usable(vector: Column) -> Column:
    """The vector is not null and neither null, NaN nor infinite anywhere."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _pack(rows: DataFrame, scale: int, n_parts: int, n_tasks: int) -> DataFrame:
    """PACKED rows of (vec_id, vector): a part's vectors of one length; those with components beyond 32 bits by themselves."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        column = table.column("vector").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        ids = table.column("vec_id").to_numpy()
        with np.errstate(over="ignore"):
            # Beyond the range of doubles the largest double stands: its products are beyond 64 bits all the same.
            flat = np.nan_to_num(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)))
        starts = np.cumsum(sizes) - sizes
        wide = np.zeros(len(ids), dtype=bool)
        wide[np.repeat(np.arange(len(ids)), sizes)[np.abs(flat) >= 2**31]] = True
        out: dict[str, list] = {"part": [], "ids": [], "dim": [], "vectors": []}
        for dim, large in sorted(set(zip(sizes.tolist(), wide.tolist(), strict=True))):
            at = np.flatnonzero((sizes == dim) & (wide == large))
            values = flat[(starts[at][:, None] + np.arange(dim)).ravel()]
            out["part"].append(key[0].as_py())
            out["ids"].append(ids[at].tobytes())
            out["dim"].append(dim)
            out["vectors"].append((values if large else values.astype(np.int32)).tobytes())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)})

    parts = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int"))
    return parts.repartition(n_tasks, "part").groupBy("part").applyInArrow(pack, PACKED)


def matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors of a PACKED row."""
    ids, dim = np.frombuffer(row["ids"], dtype=np.int64), row["dim"]
    wide = len(row["vectors"]) == 8 * len(ids) * dim and dim > 0
    return ids, np.frombuffer(row["vectors"], dtype=np.float64 if wide else np.int32).astype(np.float64).reshape(len(ids), dim)


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors as 64-bit integers; what is beyond them becomes -MOST or MOST."""
    q_sum, c_most = np.abs(q).sum(axis=1), np.abs(c).max(axis=1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = float(q_sum.max(initial=0)) * float(c_most.max(initial=0))
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)  # every partial sum is a whole number that a double holds
    fits = [np.where(np.abs(x) < 2**63, x, 0).astype(np.int64) for x in (q, c)]
    scores = fits[0] @ fits[1].T  # right modulo 2^64, and so where the bound says that it fits
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.argwhere(q_sum[:, None] * c_most[None, :] >= 2.0**62)
    if len(far):
        whole = [{int(i): [int(x) for x in v[i]] for i in np.unique(far[:, side])} for side, v in enumerate((q, c))]
        for i, j in far.tolist():
            scores[i, j] = min(max(sum(a * b for a, b in zip(whole[0][i], whole[1][j], strict=True)), -MOST), MOST)
    return scores


class Chunk:
    """Queries of one chunk in the order of their blocks, with the low end of the bin of each one's kth score."""

    def __init__(self, rows: list[dict], low: np.ndarray | None = None):
        self.rows = rows
        self.first = np.cumsum([0, *(len(r["ids"]) // 8 for r in rows)])
        self.ids = np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(r["ids"], dtype=np.int64) for r in rows)])
        self.low = low

    def scored(self, batches: Iterator[pa.RecordBatch], queries_at_once: int = 256) -> Iterator[tuple]:
        """(number of the first query, candidate ids, scores, own) for each block of candidates and some queries of their length."""
        blocks = [(first, *matrix(r)) for first, r in zip(self.first, self.rows, strict=False)]
        for batch in batches:
            for i in range(batch.num_rows):
                c_ids, c = matrix(batch.slice(i, 1).to_pylist()[0])
                for first, q_ids, q in blocks:
                    if q.shape[1] == c.shape[1]:
                        for a in range(0, len(q_ids), queries_at_once):
                            part = slice(a, a + queries_at_once)
                            yield first + a, c_ids, inner_products(q[part], c), q_ids[part, None] == c_ids[None, :]


def bins_of(scores: np.ndarray, low: np.ndarray, width: int, span: int) -> np.ndarray:
    """Each score's bin from its query's low end, -1 outside the span from there. Differences may take 64 bits."""
    with np.errstate(over="ignore"):
        beyond = scores.astype(np.int64).view(U64) - low.astype(np.int64).view(U64)
    return np.where((scores >= low) & (beyond < U64(span)), (beyond // U64(width)).view(np.int64), -1)


COUNTS = "piece int, counts binary"
#: Queries a row of histograms, and rows of tasks that are added up at once.
PIECE, MERGED = 1024, 256


def _histogram_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(counts), PIECE):
        packed = zlib.compress(counts[k : k + PIECE].astype(np.int64).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([packed], pa.binary())], ["piece", "counts"])


def _count(chunk, width: int, span: int):
    """Histograms of every query's scores, summed over the task's blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chunk.value
        counts, some = np.zeros((len(c.ids), BINS), dtype=np.int64), False
        for first, _, scores, own in c.scored(batches):
            q = np.arange(first, first + len(scores))
            bins = bins_of(scores, c.low[q, None], width, span)
            bins[own] = -1
            at = np.flatnonzero(bins.ravel() >= 0)
            flat = bins.ravel()[at] + at // max(1, scores.shape[1]) * BINS
            counts[q] += np.bincount(flat, minlength=len(q) * BINS).reshape(-1, BINS)
            some = True
        if some:
            yield from _histogram_rows(counts)

    return count


def _count_kept(chunk, width: int, span: int):
    """The same of scores that are kept already."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chunk.value
        counts, some = np.zeros((len(c.ids), BINS), dtype=np.int64), False
        for batch in batches:
            q, scores = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bins = bins_of(scores, c.low[q], width, span)
            ok = bins >= 0
            np.add.at(counts, (q[ok], bins[ok]), 1)
            some = some or len(q) > 0
        if some:
            yield from _histogram_rows(counts)

    return count


def _keep(chunk, k: int):
    """Scores from the query's low end up, of each task the k that come first."""

    def first_k(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], ids[top], scores[top]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chunk.value
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for first, c_ids, scores, own in c.scored(batches):
            at, j = np.nonzero((scores >= c.low[first : first + len(scores), None]) & ~own)
            held.append(first_k(at + first, c_ids[j], scores[at, j]))
            waiting += len(held[-1][0])
            if waiting > 2 * k * len(c.ids) + (1 << 16):
                held = [first_k(*map(np.concatenate, zip(*held, strict=True)))]
                waiting = len(held[0][0])
        if held:
            q, ids, scores = first_k(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores), pa.array(ids)], ["query", "score", "vec_id"])

    return keep


def _narrow(counted: DataFrame, tasks: int, low: np.ndarray, above: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin of each query's kth score: its low end, how many scores lie above it, and the most that one query has from there up."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    low, above, most = low.copy(), above.copy(), 0
    while tasks > MERGED:  # so many rows of a piece meet in one group at most, however many tasks there are
        tasks = -(-tasks // MERGED)
        counted = counted.groupBy("piece", F.pmod(F.xxhash64(F.spark_partition_id(), "counts"), F.lit(tasks))).applyInArrow(add, COUNTS)
    for r in counted.groupBy("piece").applyInArrow(add, COUNTS).toLocalIterator():
        total = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64).reshape(-1, BINS)
        q = slice(r["piece"] * PIECE, r["piece"] * PIECE + len(total))
        from_top = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] + above[q, None]
        # The last bin with k scores from it up; the first bin where all are fewer.
        at = np.maximum((from_top >= k).sum(axis=1) - 1, 0)
        held = from_top[np.arange(len(total)), at]
        above[q] = held - total[np.arange(len(total)), at]
        low[q] += at * width
        most = max(most, int(held.max(initial=0)))
    return low, above, most


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192, block_bytes: int = 16 << 20, query_rows: int = 1024, enough: int = 64, chunk_queries: int = 1 << 15, chunk_bytes: int = 48 << 20
) -> DataFrame:
    """The k highest integer inner products of each query with all vectors but its own.

    Components become floor(scale * x). Ties go to the smaller id. Returns
    query_id, rank (from 1), vec_id, score; all candidates where there are fewer
    than k. Scores are exact 64-bit integers; one beyond them becomes
    2^63 - 1 or its negative. Null vectors and vectors with null or non-finite components
    take no part, neither do rows without an id. A vector meets those of its length
    only. Candidates with the query's id are its own and left out; a row given twice
    is a candidate twice. A query id given twice is answered once, for the vector
    that is least in the order of its components. An empty table, or one without
    queries, gives an empty one. Other columns are not read.

    Queries go out in chunks of about chunk_queries rows and chunk_bytes at most,
    which bounds what is broadcast; the driver holds one chunk and two numbers a
    query of it. Candidates are not moved after they are packed, in blocks of block_rows
    and block_bytes on average. Refinement ends
    when the bins from the kth score up hold at most k + enough scores for every
    query, or are one score wide. Of each query every task keeps the first k from
    the low end up at most, which cannot lose a result.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        column = F.col(f"`{vector_col}`")
        return df.filter(F.col(f"`{id_col}`").isNotNull() & usable(column)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), column.cast("array<double>").alias("vector"))

    candidates = clean(vectors)
    wanted = clean(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1))
    n, largest, size = candidates.agg(F.count(F.lit(1)), F.max(norm), F.sum(8 * F.size("vector") + 8)).first()
    n_queries, n_bytes = wanted.agg(F.count(F.lit(1)), F.sum(8 * F.size("vector") + 8)).first()
    # At least four blocks a core where there are rows enough, so that small tables use all cores too.
    n_parts = max(1, math.ceil(n / block_rows), math.ceil((size or 0) / block_bytes), min(math.ceil(n / 512), 4 * spark.sparkContext.defaultParallelism))
    n_tasks = min(n_parts, max(partitions(spark), n_parts // 8))
    packed = durable(_pack(candidates, scale, n_parts, n_tasks))
    n_chunks = max(1, math.ceil(n_queries / chunk_queries), math.ceil((n_bytes or 0) / chunk_bytes))
    per_chunk = max(1, math.ceil(n_queries / n_chunks / query_rows))
    asked = durable(_pack(wanted, scale, n_chunks * per_chunk, min(n_chunks * per_chunk, partitions(spark))))
    # |score| is at most the product of two norms.
    reach = math.ceil(min((largest or 0.0) * (1 + 1e-9), 2.0**62)) + 1 if (largest or 0.0) < 2.0**62 else MOST

    def answer(rows: list[dict]) -> DataFrame:
        chunk = Chunk(rows, np.full(sum(len(r["ids"]) // 8 for r in rows), -reach, dtype=np.int64))
        sent = spark.sparkContext.broadcast(chunk)
        span = 2 * reach + 1
        width = -(-span // BINS)
        low, above, most = _narrow(packed.mapInArrow(_count(sent, width, span), COUNTS), n_tasks, chunk.low, np.zeros(len(chunk.ids), dtype=np.int64), width, k)
        sent = spark.sparkContext.broadcast(Chunk(rows, low))
        kept = durable(packed.mapInArrow(_keep(sent, k), "query long, score long, vec_id long"))
        while width > 1 and most > k + enough:
            span, width = width, -(-width // BINS)
            low, above, most = _narrow(kept.mapInArrow(_count_kept(spark.sparkContext.broadcast(Chunk(rows, low)), width, span), COUNTS), n_tasks, low, above, width, k)
        last = spark.sparkContext.broadcast((chunk.ids, low))

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, least = last.value
            for batch in batches:
                q, scores = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                ok = scores >= least[q]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[ok]]), pa.array(scores[ok]), batch.column(2).filter(pa.array(ok))], ["query_id", "score", "vec_id"])

        near = kept.mapInArrow(name, "query_id long, score long, vec_id long")
        rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def chunk_rows(number: int) -> list[dict]:
        return [r.asDict() for r in asked.filter(F.pmod("part", F.lit(n_chunks)) == number).orderBy("part", "dim", "ids").collect()]

    if n_chunks == 1:
        return answer(chunk_rows(0))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    for number in range(n_chunks):
        answer(chunk_rows(number)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
