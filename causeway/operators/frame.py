"""Relational steps around a sample matrix or an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.columns import epoch, norm2
from causeway.operators.independence import level_codes


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any", subset=columns)


def drop_empty_fill(df: DataFrame, columns: list[str], value: float = 0) -> DataFrame:
    """Rows that are null throughout go; other nulls become value."""
    return df.na.drop("all", subset=columns).na.fill(value, subset=columns)


def time_bins(df: DataFrame, ts: Column, width: float, name: str = "bin") -> DataFrame:
    """df with the number of the tumbling window of `width` seconds that ts is in."""
    return df.withColumn(name, F.floor(ts / width).cast("long"))


def window_counts(events: DataFrame, event: str, ts: Column, width: float) -> DataFrame:
    """(bin, event, n) in long form."""
    return time_bins(events, ts, width).groupBy("bin", F.col(f"`{event}`").alias("event")).agg(F.count(F.lit(1)).alias("n"))


def window_pivot(events: DataFrame, event: str, ts: Column, width: float, names: list | None = None) -> DataFrame:
    """One row a window, one count column an event, 0 where there is none.

    names: the events, in the order of the columns; found with one more pass if not given.
    """
    if names is None:
        names = [r[0] for r in events.select(F.col(f"`{event}`")).filter(F.col(f"`{event}`").isNotNull()).distinct().orderBy(F.col(f"`{event}`")).collect()]
    binned = time_bins(events, ts, width)
    return binned.groupBy("bin").agg(*[F.count(F.when(F.col(f"`{event}`") == F.lit(n), 1)).alias(str(n)) for n in names])


def event_multiplicity(events: DataFrame, event: str = "event", ts: str = "timestamp", node: str = "node") -> DataFrame:
    """How often an event comes at one node at one time: node, timestamp, event, times."""
    cols = [F.col(f"`{c}`").alias(a) for c, a in ((node, "node"), (ts, "timestamp"), (event, "event"))]
    return events.select(*cols).na.drop("any").groupBy("node", "timestamp", "event").agg(F.count(F.lit(1)).alias("times"))


def on_topology(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events at the nodes of a topology."""
    return events.join(nodes.select(F.col(nodes.columns[0]).alias("node")), "node", "left_semi")


def ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the position of the column's value among its sorted distinct values, from 0."""
    codes = level_codes(df, column)
    return df.join(codes.withColumnsRenamed({"value": "_value", "code": name}), F.col(f"`{column}`") == F.col("_value"), "left").drop("_value")


def standardise(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """Columns less their mean, over their standard deviation (of the population, or of a sample)."""
    deviation = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(*[f(F.col(f"`{c}`")).alias(f"_{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", deviation))]).withColumn("_one", F.lit(1))
    joined = df.join(F.broadcast(stats), F.lit(1) == F.col("_one"))  # one row of statistics
    done = {c: (F.col(f"`{c}`") - F.col(f"_m_{i}")) / F.when(F.col(f"_s_{i}") > 0, F.col(f"_s_{i}")).otherwise(1.0) for i, c in enumerate(columns)}
    return joined.select(*[done[c].alias(c) if c in done else F.col(f"`{c}`") for c in df.columns])


def centre(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"_m_{i}") for i, c in enumerate(columns)]).withColumn("_one", F.lit(1))
    joined = df.join(F.broadcast(stats), F.lit(1) == F.col("_one"))
    return joined.select(*[(F.col(f"`{c}`") - F.col(f"_m_{columns.index(c)}")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def unit_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's columns over their Euclidean norm."""
    norm = F.greatest(norm2([F.col(f"`{c}`") for c in columns]), F.lit(1e-12))
    return df.withColumns({c: F.col(f"`{c}`") / norm for c in columns})


def residual(df: DataFrame, y: str, x: str, name: str = "residual") -> DataFrame:
    """df with y less its regression on x (sample covariance over population variance)."""
    stats = df.agg((F.covar_samp(F.col(f"`{y}`"), F.col(f"`{x}`")) / F.var_pop(F.col(f"`{x}`"))).alias("_b")).withColumn("_one", F.lit(1))
    return df.join(F.broadcast(stats), F.lit(1) == F.col("_one")).withColumn(name, F.col(f"`{y}`") - F.col("_b") * F.col(f"`{x}`")).drop("_b", "_one")


def poisson_weight(seed: int, replicate: Column, key: list[str]) -> Column:
    """How often, by a Poisson(1) draw, a row counts in a replicate: a hash of its key decides."""
    #: Cumulative probabilities of Poisson(1).
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]
    u = F.pmod(F.xxhash64(F.lit(seed), replicate, *[F.col(f"`{k}`") for k in key]), F.lit(1 << 40)) / float(1 << 40)
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def replicates(df: DataFrame, n: int, key: list[str], seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Poisson bootstrap: (replicate, weight, columns...) with each row weighing a Poisson(1) number of times.

    Draws depend on the row's key and the seed only, so any partitioning gives the
    same replicates, and all of them come from one pass without a shuffle.
    """
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("weight", poisson_weight(seed, F.col("replicate"), key))
    return rows.filter("weight > 0").select("replicate", "weight", *[F.col(f"`{c}`") for c in columns or df.columns])


def split_by_hash(df: DataFrame, key: list[str], share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; a row's side depends on its key alone."""
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]), F.lit(1 << 40)) / float(1 << 40)
    return df.filter(u < share), df.filter(u >= share)


def segments(df: DataFrame, series: str, order: str, values: list[str], window: int) -> DataFrame:
    """Last-aligned windows of growing length of every series, padded with zeros: (series, feature, segments).

    Element k of a feature's array holds its last k + 1 values and then zeros.
    """
    packed = df.groupBy(F.col(f"`{series}`").alias("series")).agg(F.array_sort(F.collect_list(F.struct(F.col(f"`{order}`").alias("o"), *[F.col(f"`{v}`").cast("double").alias(v) for v in values]))).alias("rows"))
    long = packed.select("series", F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.slice(F.reverse(F.col(f"rows.{v}")), 1, window).alias("last")) for v in values])).alias("f")).select("series", "f.*")
    cut = lambda k: F.concat(F.reverse(F.slice("last", 1, k)), F.array_repeat(F.lit(0.0), F.lit(window) - F.least(k, F.size("last"))))
    return long.select("series", "feature", F.transform(F.sequence(F.lit(1), F.lit(window)), cut).alias("segments"))


def event_seconds(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("timestamp", epoch(F.col(f"`{ts}`")))
