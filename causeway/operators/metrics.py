"""How close an estimated graph comes to the true one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.graph import typed


def compare(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """(a, b, est, tru): kinds of every pair that either graph joins; null where it does not."""
    e = typed(estimated).select("a", "b", F.col("kind").alias("est"))
    return e.join(typed(truth).select("a", "b", F.col("kind").alias("tru")), ["a", "b"], "full_outer")


def graph_metrics(estimated: DataFrame, truth: DataFrame, n_nodes: int, undirected: DataFrame | None = None) -> DataFrame:
    """One row: fdr, tpr, fpr, shd, nnz, precision, recall, f1, gscore; rounded to four digits.

    undirected: estimated edges without a direction, where they are given apart, each once or in both directions.

    Loops do not count. An undirected edge counts once for fdr, tpr, fpr, shd and
    nnz, and is right where the skeleton is; for precision, recall, f1 and gscore
    it counts as two directed ones.
    """
    if undirected is not None:
        lines = undirected.select("src", "dst")
        estimated = estimated.select("src", "dst").union(lines).union(lines.select("dst", "src"))
    c = compare(estimated, truth)
    has_e, has_t, line = F.col("est").isNotNull(), F.col("tru").isNotNull(), F.col("est") == "undirected"
    both = has_e & has_t

    def times(cond) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    def entries(kind) -> Column:
        return F.coalesce(F.sum(F.when(F.col(kind) == "undirected", 2).when(F.col(kind).isNotNull(), 1).otherwise(0)), F.lit(0))

    right = both & (line | (F.col("est") == F.col("tru")) | (F.col("tru") == "undirected"))
    hits = F.when(both & line & (F.col("tru") == "undirected"), 2).when(right, 1).otherwise(0)
    counts = c.agg(
        times(right).alias("tp"), times(has_e & ~has_t).alias("fp"), times(both & ~right).alias("turned"), times(has_e & ~has_t).alias("extra"), times(has_t & ~has_e).alias("missing"),
        times(has_e).alias("nnz"), times(has_t).alias("cond"), entries("est").alias("pe"), entries("tru").alias("te"), F.coalesce(F.sum(hits), F.lit(0)).alias("hits"),
    )
    wrong = F.col("turned") + F.col("fp")
    negatives = n_nodes * (n_nodes - 1) / 2 - F.col("cond")
    precision, recall = F.col("hits") / F.nullif(F.col("pe"), F.lit(0)), F.col("hits") / F.nullif(F.col("te"), F.lit(0))
    rates = {
        "fdr": wrong / F.greatest(F.col("nnz"), F.lit(1)),
        "tpr": F.col("tp") / F.greatest(F.col("cond"), F.lit(1)),
        "fpr": wrong / F.greatest(negatives, F.lit(1)),
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)),
        "gscore": F.greatest(F.lit(0), F.col("hits") - (F.col("pe") - F.col("hits"))) / F.nullif(F.col("te"), F.lit(0)),
    }
    return counts.select(*[F.round(v, 4).alias(k) for k, v in rates.items()], (F.col("extra") + F.col("missing") + F.col("turned")).cast("long").alias("shd"), F.col("nnz").cast("long").alias("nnz"))


def edge_parts(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """(part, a, b): extra, missing, reversed and right pairs."""
    c = compare(estimated, truth)
    part = (
        F.when(F.col("tru").isNull(), "extra")
        .when(F.col("est").isNull(), "missing")
        .when((F.col("est") == F.col("tru")) | (F.col("est") == "undirected") | (F.col("tru") == "undirected"), "right")
        .otherwise("reversed")
    )
    return c.select(part.alias("part"), "a", "b")
