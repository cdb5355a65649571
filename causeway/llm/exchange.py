"""Counting content hashes across a corpus by an exchange of packed arrays.

A corpus has one hash for each window or anchor, far more rows than a row-wise
groupBy should carry. Each block of documents sorts its hashes, merges equal
ones, and sends one row of packed 64-bit values to each hash bucket; Spark
groups the rows of a bucket, the group decides which values occur twice, and one
bit a value goes back to the block. A value that every block holds reaches its
bucket once a block, so no hot value makes a hot task.

The bucket is taken from a second, independent hash, so values that meet agree
in 64 bits and in the bucket's number: buckets are sized by a fixed number of
values, and the expected false matches stay at (values x bucket size) / 2^64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "bucket int, block int, hashes binary, twice binary"
BACK = "block int, bucket int, bits binary"
COUNTED = SENT + ", number binary"
COUNTED_BACK = BACK + ", many binary"


class Packed:
    """A block's hashes in the order in which they travel; with contexts, also how many different ones each has."""

    def __init__(self, value: np.ndarray, spread: np.ndarray, n_buckets: int, context: np.ndarray | None = None):
        bucket = (spread % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        v, b = value[order], bucket[order]
        fresh = np.ones(len(v), dtype=bool)
        fresh[1:] = (v[1:] != v[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(fresh)
        self.order = order
        self.entry = np.cumsum(fresh) - 1
        self.value, self.bucket = v[at], b[at]
        self.twice = np.diff(np.append(at, len(v))) > 1
        edges = np.flatnonzero(np.diff(self.bucket)) + 1
        self.edges = np.concatenate([[0], edges, [len(self.value)]]) if len(self.value) else np.zeros(1, dtype=np.int64)
        self.number = None
        if context is not None:
            again = self.twice[self.entry]
            e, c = self.entry[again], context[order[again]]
            by = np.lexsort((c, e))
            e, c = e[by], c[by]
            new = np.ones(len(e), dtype=bool)
            new[1:] = (e[1:] != e[:-1]) | (c[1:] != c[:-1])
            self.number = np.minimum(np.bincount(e[new], minlength=len(self.value)), 65535).astype(np.uint16)

    def rows(self, block: int) -> pa.Table:
        cuts = list(zip(self.edges[:-1], self.edges[1:], strict=True))
        number = {} if self.number is None else {"number": pa.array([self.number[a:b][self.twice[a:b]].tobytes() for a, b in cuts], pa.binary())}
        return pa.table(
            {
                "bucket": pa.array(self.bucket[self.edges[:-1]], pa.int32()),
                "block": pa.array(np.full(len(cuts), block), pa.int32()),
                "hashes": pa.array([self.value[a:b].tobytes() for a, b in cuts], pa.binary()),
                "twice": pa.array([np.packbits(self.twice[a:b]).tobytes() for a, b in cuts], pa.binary()),
                **number,
            }
        )

    def answered(self, bits: dict[int, bytes]) -> np.ndarray:
        """For each of the hashes given at first: does it occur twice in the corpus?"""
        found = np.zeros(len(self.value), dtype=bool)
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            found[a:b] = np.unpackbits(np.frombuffer(bits[int(self.bucket[a])], dtype=np.uint8), count=b - a).view(bool)
        out = np.empty(len(self.order), dtype=bool)
        out[self.order] = found[self.entry]
        return out


def _decide(table: pa.Table, most: int | None) -> pa.Table:
    hashes = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in hashes])
    value = np.concatenate(hashes)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).view(bool) for x, n in zip(table.column("twice").to_pylist(), sizes, strict=True)])
    if most is not None:
        number = np.ones(len(value), dtype=np.int64)
        number[twice] = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in table.column("number").to_pylist()])
    order = np.argsort(value)
    v = value[order]
    same = v[1:] == v[:-1]
    met = np.zeros(len(v), dtype=bool)
    met[1:] |= same
    met[:-1] |= same
    # A value that is twice in one block comes from that block once, so it counts by itself.
    repeated = twice
    repeated[order] |= met
    ends = np.cumsum(sizes)

    def packed(bits: np.ndarray) -> pa.Array:
        return pa.array([np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())

    back = {"block": table.column("block"), "bucket": table.column("bucket"), "bits": packed(repeated)}
    if most is not None:
        at = np.flatnonzero(np.concatenate([[True], ~same]))
        many = np.empty(len(v), dtype=bool)
        many[order] = np.repeat(np.add.reduceat(number[order], at) > most, np.diff(np.append(at, len(v))))
        back["many"] = packed(many)
    return pa.table(back)


def repeated(sent: DataFrame, most: int | None = None) -> DataFrame:
    """(block, bucket, bits) for every row of SENT: a bit for each hash that occurs twice.

    With most, sent has COUNTED rows, and bits many tell the hashes with more contexts than that.
    """
    return sent.groupBy("bucket").applyInArrow(lambda table: _decide(table, most), BACK if most is None else COUNTED_BACK)


def send(blocked: DataFrame, hashes: Callable[[pa.Table], tuple[np.ndarray, ...]], n_buckets: int, schema: str = SENT) -> DataFrame:
    """SENT rows of every block. hashes: gives a block's values and their spreading hashes, for COUNTED rows also their contexts'."""

    def emit(key: tuple, table: pa.Table) -> pa.Table:
        value, spread, *context = hashes(table)
        return Packed(value, spread, n_buckets, *context).rows(key[0].as_py())

    return blocked.groupBy("block").applyInArrow(emit, schema)


def bits_of(table: pa.Table, name: str = "bits") -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column(name).to_pylist(), strict=True))
