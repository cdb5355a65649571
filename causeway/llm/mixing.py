"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into hash blocks. A source's target becomes a quota of block
draws: whole passes over all of its blocks, and a rest. A binary tree splits the
quotas of all sources among the output shards, each node by one multivariate
hypergeometric draw, so they stay exact; a leaf draws as many blocks of each source
as it was dealt, in an order of its own and none that another leaf has drawn in the
same pass. A source's last leaf settles what the blocks differ from the target in
words. A leaf's rows are shuffled within the shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .frames import durable

#: At most so many blocks in all (besides one a source), and so many sources: what the driver plans with.
MOST_BLOCKS = 1 << 15
MOST_SOURCES = 1 << 20
ADDED = ("mix_shard", "mix_copy")


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: share of all sizes by weight, at most `most` times a source's size.

    Weights repeat over the sources by code point, null last. What a source may
    not take is shared among the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        part = {s: left * weight[s] / total for s in free}
        above = [s for s in free if part[s] > most * sizes[s]]
        if not above:
            return out | part
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in above]
    return out


def split_quotas(sources: np.ndarray, quotas: np.ndarray, shards: int, rng: np.random.Generator, first: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, draws of each) of every leaf; a source's draws add up to its quota. Nodes hold the sources that have draws left."""
    some = quotas > 0
    sources, quotas = sources[some], quotas[some]
    if shards == 1:
        yield first, sources, quotas
    elif len(sources):
        half = shards // 2
        left = rng.multivariate_hypergeometric(quotas, round(int(quotas.sum()) * half / shards), method="marginals")
        yield from split_quotas(sources, left, half, rng, first)
        yield from split_quotas(sources, quotas - left, shards - half, rng, first + half)


class _Draws:
    """One source's draws, leaf by leaf: (block, copy, shard), where copy numbers the passes over the blocks."""

    def __init__(self, words: np.ndarray, wanted: float):
        self.words = words
        total = int(words.sum())
        self.passes, self.rest = int(wanted // total), float(wanted - wanted // total * total)
        #: Blocks of the rest that leaves draw; the last of them settles the difference.
        self.quota = self.passes * len(words) + int(self.rest / total * len(words))
        self.left = np.zeros(0, dtype=np.int64)
        self.copy, self.shard, self.draws = -1, 0, []

    def take(self, n: int, shard: int, seed: int, number: int) -> None:
        rng = np.random.default_rng((seed, number, shard))
        self.shard = shard
        while n:
            if not len(self.left):
                self.left, self.copy = np.arange(len(self.words)), self.copy + 1
            self.left = rng.permutation(self.left)
            now, self.left = self.left[:n], self.left[n:]
            self.draws += [(int(b), self.copy, shard) for b in now]
            n -= len(now)

    def settle(self, seed: int, number: int) -> tuple[int, float] | None:
        """Whole blocks of the rest up to its words, and the block that is cut and what it gives."""
        rest = [d for d in self.draws if d[1] == self.passes]
        self.draws = self.draws[: len(self.draws) - len(rest)]
        left = np.setdiff1d(np.arange(len(self.words)), [b for b, *_ in rest])
        rest += [(int(b), self.passes, self.shard) for b in np.random.default_rng((seed, number)).permutation(left)]
        sums = np.cumsum(self.words[[b for b, *_ in rest]])
        whole = int(np.searchsorted(sums, self.rest, side="right"))
        self.draws += rest[:whole]
        over = self.rest - (sums[whole - 1] if whole else 0)
        if whole == len(rest) or over <= 0:
            return None
        self.draws.append(rest[whole])
        return rest[whole][0], float(over)


@dataclass
class Mix:
    """A planned mixture. sized: doc_id, size, source and places of every row; draws: what each block gives."""

    docs: DataFrame
    sized: DataFrame
    sources: DataFrame
    draws: DataFrame
    source_col: str
    keys: list[Column]
    shards: int

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, copies, taken, shards (one for each copy) of every row of docs."""
        per_block = self.draws.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "upto"))).alias("given"))
        rows = self.sized.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("source_name")))
        rows = rows.withColumn("block", F.pmod("place", F.col("blocks")).cast("int")).join(F.broadcast(per_block), ["source_no", "block"], "left")
        given = F.filter(F.coalesce("given", F.array()), lambda d: d["upto"].isNull() | (F.col("inner") <= d["upto"]))
        rows = rows.withColumn("shards", F.transform(given, lambda d: d["shard"])).withColumn("copies", F.size("shards"))
        return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "shards")

    def rows(self, keep: bool = True) -> DataFrame:
        """The mixture: rows of docs with all their columns, a row for each draw, by shard and shuffled within it.

        keep=False leaves out the added columns mix_shard and mix_copy; with them,
        columns of docs of those names are replaced.
        """
        whole = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"), F.col(f"`{self.source_col}`").cast("string").alias("source"), *self.keys)
        placed = whole.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("source_name"))).withColumn("block", F.pmod("place", F.col("blocks")).cast("int"))
        drawn = placed.join(F.broadcast(self.draws), ["source_no", "block"]).filter(F.col("upto").isNull() | (F.col("inner") <= F.col("upto")))
        drawn = drawn.repartition(F.col("shard")).sortWithinPartitions("shard", F.xxhash64("inner", "copy"), "inner", "copy")
        own = [F.col(f"row.`{c}`") for c in self.docs.columns if not keep or c not in ADDED]
        return drawn.select(*own, *([F.col(x).alias(name) for x, name in zip(("shard", "copy"), ADDED, strict=True)] if keep else []))


def plan_mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, shard_words: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> Mix:
    """Plan a mixture of the rows of docs that comes near each source's target of words.

    A row's place depends on its id, its text and the seed alone, so reruns
    agree. A source differs from its target by half a document at most, as the
    last block is cut where its sum of words comes nearest. No row is drawn more
    than ceil(most) times. Null texts have size 0 and are drawn with their block;
    null is a source of its own, the last. Rows given twice are drawn alike. An
    empty table, or one without words, gives an empty mixture.

    Very long texts are counted whole. Other columns are not read. The driver handles
    totals of at most MOST_BLOCKS blocks and one a source; over MOST_SOURCES sources
    are refused.
    """
    place = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keys = [place.alias("place"), F.xxhash64(place, F.lit(seed + 1)).alias("inner")]
    sized = durable(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), *keys))
    spark = docs.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: int(r["n"]) for r in found}
    wanted = targets(sizes, weights, share, most)
    total = sum(sizes.values())
    words_a_block = max(1.0, total / MOST_BLOCKS)
    names = list(wanted)
    blocks = [max(1, math.ceil(sizes[s] / words_a_block)) for s in names]
    schema = "source_no int, source_name string, source_size long, target double, blocks int"
    sources = spark.createDataFrame([(i, s, sizes[s], float(wanted[s]), b) for i, (s, b) in enumerate(zip(names, blocks, strict=True))], schema)
    placed = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source_name"))).withColumn("block", F.pmod("place", F.col("blocks")).cast("int"))
    held = placed.groupBy("source_no", "block").agg(F.sum("size").alias("n")).toPandas()
    words = [np.zeros(b, dtype=np.int64) for b in blocks]
    for no, block, n in held.itertuples(index=False):
        words[no][block] = n

    plans = [_Draws(words[i], wanted[s]) if sizes[s] else None for i, s in enumerate(names)]
    quotas = np.array([p.quota if p else 0 for p in plans], dtype=np.int64)
    shards = max(1, min(int(quotas.sum()), math.ceil(share * total / shard_words)))
    for shard, some, draws in split_quotas(np.arange(len(names)), quotas, shards, np.random.default_rng(seed)):
        for i, n in zip(some.tolist(), draws.tolist(), strict=True):
            plans[i].take(n, shard, seed, i)
    part = {i: cut for i, p in enumerate(plans) if p and (cut := p.settle(seed, i))}
    upto = _cuts(placed, part)
    out = []
    for i, p in enumerate(plans):
        for k, (block, copy, shard) in enumerate(p.draws if p else []):
            is_cut = i in part and k == len(p.draws) - 1
            if not is_cut or i in upto:
                out.append((i, block, copy, shard, upto[i] if is_cut else None))
    fields = [("source_no", T.IntegerType()), ("block", T.IntegerType()), ("copy", T.IntegerType()), ("shard", T.IntegerType()), ("upto", T.LongType())]
    return Mix(docs, sized, sources, spark.createDataFrame(out, T.StructType([T.StructField(*f) for f in fields])), source_col, keys, shards)


def _cuts(placed: DataFrame, part: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each source, the last place within its cut block that is still drawn."""
    if not part:
        return {}
    wanted = placed.sparkSession.createDataFrame([(i, b, over) for i, (b, over) in part.items()], "source_no int, block int, over double")
    rows = placed.join(F.broadcast(wanted), ["source_no", "block"])
    so_far = F.sum("size").over(W.Window.partitionBy("source_no").orderBy("inner").rangeBetween(W.Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") - F.col("size") / 2 <= F.col("over"))
    return {r["source_no"]: r["upto"] for r in rows.groupBy("source_no").agg(F.max("inner").alias("upto")).collect()}
