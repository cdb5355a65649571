"""Groups whose members are compared pair by pair: small ones whole, large ones in pairs of tiles.

A group over `size` members (or in a bucket of groups with as many) is cut into tiles by a hash, and every pair of its tiles is a
group of its own, which some task compares. No task so holds more than two tiles, and
members travel as often as their group has tiles: once, unless it is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["tile_a", "tile_b", "mine"]


def tiled(rows: DataFrame, key: str, salt: Column, size: int, total: int) -> DataFrame:
    """rows with (tile_a, tile_b, mine), dealt and sorted so that each pair of tiles lies together.

    total: a bound on the number of rows. Rows are counted by buckets of keys that hold
    few each, merged where they are made; a bucket over `size` rows, of which there are at
    most total / size, has all its keys cut into as many tiles as its rows fill. Those few
    buckets are broadcast if they are under a million, and met by a shuffle otherwise.
    """
    bucket = F.pmod(F.col(key), F.lit(max(4096, 10 * total // size)))
    hot = rows.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > size).select("bucket", F.ceil(F.col("count") / size).cast("int").alias("tiles"))
    placed = rows.withColumn("salt", salt).withColumn("bucket", bucket).join(F.broadcast(hot) if total // size < 10**6 else hot, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = placed.withColumn("mine", F.pmod("salt", "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sides = mine.select(*rows.columns, F.least("mine", "other").alias("tile_a"), F.greatest("mine", "other").alias("tile_b"), "mine")
    return sides.repartition(key, "tile_a", "tile_b").sortWithinPartitions(key, *PLACE)


def grouped(batches: Iterator[pa.RecordBatch], key: str = "key", rows: int = 4000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole groups of sorted rows, some at a time: their batch, the number of each row's group, and its tile.

    The tile is -1 in groups whose members all meet; in others only members of different tiles do.
    """
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        columns = [table.column(c).to_numpy() for c in (key, "tile_a", "tile_b")]
        fresh = np.zeros(len(table), dtype=np.int64)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.cumsum(fresh), np.where(columns[1] == columns[2], -1, table.column("mine").to_numpy())

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.concat_batches(held)
        number, tile = numbered(table)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield table.slice(0, cut), number[:cut], tile[:cut]
        held = [table.slice(cut)]
        rows = max(rows, 2 * (len(table) - cut))  # a long group is not numbered anew at every batch
    if sum(b.num_rows for b in held):
        table = pa.concat_batches(held)
        yield table, *numbered(table)


def candidate_pairs(number: np.ndarray, tile: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows that meet, about `most` at a time."""
    first, held, n = np.arange(len(number)), [], 0
    step = 1
    while len(first):
        first = first[first + step < len(number)]
        first = first[number[first] == number[first + step]]
        meet = first[(tile[first] < 0) | (tile[first] != tile[first + step])]
        held.append((meet, meet + step))
        n += len(meet)
        step += 1
        if n >= most or not len(first):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
