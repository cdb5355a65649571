"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

As many sequences are opened as all tokens fill. Then, round after round, the pieces
that have no place and the gaps that are left are range-sorted together by size, and a
sweep from the largest size down gives each piece its successor among the gaps: the
smallest one that holds it and that no larger piece has taken. Each range is swept by
one task, which leaves over pieces that found no gap and gaps that no piece took; only
their numbers go to the driver, which says what ranges of ranks meet across tasks, and
the pieces and gaps of equal rank are joined. Gaps are updated, and the next round
begins. A gap that several of the largest pieces left would fit into is as many slots.
Where gaps hold no piece, or few are placed, sequences are opened for what is left.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .frames import chunks, durable, partitions, releasing, tidy

#: The faster encoder's pattern goes back over a run of white space, and fails from some 700,000 characters on.
LONG_SPACE = re.compile(r"\s{100000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A piece (key) is placed in a slot of a sequence; null where there is none.
MATCHED = "task int, key long, length long, sequence_id long, slot int, rank long"


def vocabulary(path: str | None = None) -> str:
    """Path of the byte-level BPE vocabulary; the public one by default."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts, as the tokenizers library gives them without special tokens.

    Where a rank file of the same vocabulary lies beside the JSON file, the faster
    implementation of the same merges encodes; texts that hold the special
    token's string or too long a run of white space for its pattern, and
    vocabularies without that file, take the other one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special) and not LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, whatever the number of its tasks."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; where there are several, the first takes what is over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, capacity: int, id_col: str, text_col: str, path: str, end: int = 0) -> DataFrame:
    """PIECES of every row: its ids, then the end id, cut to at most capacity."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder(text), np.array([end], dtype="<u4"))
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(releasing(encode), PIECES)


def sweep(events: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MATCHED rows of one task's slots and pieces, which come by size, the largest first, slots before pieces.

    Ranks number the pieces that find no slot, and the slots that no piece takes, in the order of the task.
    """
    kinds = {"task": pa.int32(), "key": pa.int64(), "length": pa.int64(), "sequence_id": pa.int64(), "slot": pa.int32(), "rank": pa.int64()}
    task, free, over = None, [], 0

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    for batch in events:
        found = []
        for task, size, piece, key, slot in zip(*(batch.column(k).to_pylist() for k in ("task", "size", "piece", "key", "slot")), strict=True):  # noqa: B007
            if not piece:
                free.append((key, slot))
            elif free:
                found.append((task, key, size, *free.pop(), None))
            else:
                found.append((task, key, size, None, None, over))
                over += 1
        yield rows(found)
    yield rows([(task, None, None, *x, k) for k, x in enumerate(free)])


def meetings(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Rows (task of pieces, first rank, task of slots, last rank, number, first pair): ranks of pieces up meet ranks of slots down.

    counts: (task, pieces left over, slots left over), by task, the largest sizes first.
    """
    out, stack, pairs = [], [], 0
    for task, pieces, slots in counts:
        rank = 0
        while pieces and stack:
            other, left = stack.pop()
            n = min(pieces, left)
            out.append((task, rank, other, left - 1, n, pairs))
            rank, pieces, pairs = rank + n, pieces - n, pairs + n
            if left > n:
                stack.append((other, left - n))
        if slots:
            stack.append((task, slots))
    return np.array(out, dtype=np.int64).reshape(-1, 6)


def _numbered(over: DataFrame, table: np.ndarray, side: int) -> DataFrame:
    """Pieces (side 0) or slots (side 1) left over with the number of the pair that they belong to; null if to none."""
    first = table[:, 1] if side == 0 else table[:, 3] - table[:, 4] + 1
    order = np.lexsort((first, table[:, 2 * side]))
    table, first = table[order], first[order]
    keys = (table[:, 2 * side] << 40) + first

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, rank = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            at = np.maximum(np.searchsorted(keys, (task << 40) + rank, side="right") - 1, 0)
            row, beyond = table[at], rank - first[at]
            none = (row[:, 2 * side] != task) | (beyond < 0) | (beyond >= row[:, 4])
            pair = row[:, 5] + (beyond if side == 0 else row[:, 4] - 1 - beyond)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(pair, pa.int64(), mask=none)], ["one", "other", "pair"])

    one, other = (("key", "length"), ("sequence_id", "slot"))[side]
    rows = over.filter("key is not null" if side == 0 else "key is null")
    return rows.select("task", "rank", one, F.col(other).cast("long")).mapInArrow(number, "one long, other long, pair long").withColumnsRenamed({"one": one, "other": other})


def _round(unplaced: DataFrame, gaps: DataFrame, largest: int, n_tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces placed (key, length, sequence_id, slot), pieces left and gaps left after one sweep.

    largest: the longest piece that a gap holds.
    """
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("int")
    free = gaps.withColumn("slots", slots).select(F.floor(F.col("gap") / F.col("slots")).alias("size"), F.lit(False).alias("piece"), F.col("sequence_id").alias("key"), F.explode(F.expr("sequence(1, slots)")).alias("slot"))
    events = free.union(unplaced.select("length", F.lit(True), "key", F.lit(0))).withColumn("mixed", F.xxhash64("key", "slot"))
    order = [F.desc("size"), F.asc("piece"), F.asc("mixed"), F.asc("key"), F.asc("slot")]
    ranged = events.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order)
    swept = durable(ranged.select(F.spark_partition_id().alias("task"), "size", "piece", "key", "slot").mapInArrow(releasing(sweep), MATCHED))
    columns = ["key", "length", "sequence_id", "slot"]
    placed = swept.filter("rank is null").select(*columns)
    over = swept.filter("rank is not null")
    counts = over.groupBy("task").agg(F.count("key").alias("pieces"), F.count("slot").alias("slots")).orderBy("task").collect()
    table = meetings([tuple(r) for r in counts])
    if len(table):
        met = _numbered(over, table, 0).join(_numbered(over, table, 1).filter("pair is not null"), "pair", "left")
        met = durable(met.select("key", "length", "sequence_id", F.col("slot").cast("int").alias("slot")))
        placed = placed.union(met.filter("slot is not null"))
        left = met.filter("slot is null").select("key", "length")
    else:
        left = over.filter("key is not null").select("key", "length")
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    gaps = durable(gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).filter("gap > 0"))
    return placed, left, gaps


def best_fit(items: DataFrame, capacity: int, task_rows: int = 500_000) -> DataFrame:
    """(key, sequence_id, offset) of all items (key long, length long), keys different and lengths up to capacity.

    Bulk-synchronous rounds; the driver holds a few totals, and two numbers a task.
    """
    spark = items.sparkSession
    unplaced, gaps = items, spark.createDataFrame([], "sequence_id long, gap long")
    n, total, shortest, large = items.agg(F.count(F.lit(1)), F.sum("length"), F.min("length"), F.count_if(F.col("length") > capacity // 2)).first()
    opened, widest, placed, few = 0, 0, [], False
    while n:
        if few or widest < shortest:
            new = max(-(-total // capacity), large if not opened else 0)
            gaps = gaps.union(spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap")))
            opened, widest = opened + new, capacity
        # Gaps that no piece left fits into are done with.
        gaps = gaps.filter(F.col("gap") >= shortest)
        largest, n_gaps = unplaced.filter(F.col("length") <= widest).agg(F.max("length")).first()[0], gaps.count()
        n_tasks = max(1, min(partitions(spark), -(-(n + n_gaps) // 20_000)), (n + n_gaps) // task_rows)
        found, unplaced, gaps = _round(unplaced, gaps, largest, n_tasks)
        placed.append(found.withColumn("round", F.lit(len(placed))))
        before = n
        n, total, shortest = unplaced.agg(F.count(F.lit(1)), F.sum("length"), F.min("length")).first()
        widest, few = gaps.agg(F.max("gap")).first()[0] or 0, 20 * (before - n) < before
        tidy(spark)
    if not placed:
        return items.select("key", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = placed[0]
    for found in placed[1:]:
        every = every.union(found)
    offset = F.sum("length").over(W.Window.partitionBy("sequence_id").orderBy("round", "slot")) - F.col("length")
    return every.select("key", "sequence_id", offset.alias("offset"))


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Place every row's tokens in sequences of at most `capacity` tokens, as few as best fit finds.

    Returns one row per piece: doc_id, piece (from 0), start, length, ids_crc32
    (of its little-endian unsigned 32-bit ids), sequence_id, offset. Only rows of
    more than capacity tokens are cut, very long ones into many pieces. A null or
    empty text is one piece, the end id alone. Rows given twice, and rows without an
    id, are each packed. Which of equally long pieces goes where may differ between
    runs. An empty table gives an empty one. Other columns are not read.
    """
    pieces = durable(tokenised(docs, capacity, id_col, text_col, vocabulary(tokenizer)).withColumn("key", F.monotonically_increasing_id()))
    where = best_fit(pieces.select("key", "length"), capacity)
    return pieces.join(where, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
