"""Prior knowledge about edges: (src, dst, status) with 1 required, 0 forbidden; pairs without a row are open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED, FORBIDDEN = 1, 0


def prior_table(spark: SparkSession, required: list[tuple] = (), forbidden: list[tuple] = (), undirected: list[tuple] = ()) -> DataFrame:
    """undirected: pairs required in both directions. A later statement about a pair replaces an earlier one."""
    status = {e: FORBIDDEN for e in forbidden} | {e: REQUIRED for e in required} | {e: REQUIRED for a, b in undirected for e in ((a, b), (b, a))}
    return spark.createDataFrame([(a, b, s) for (a, b), s in status.items()], "src int, dst int, status int")


def remove(priors: DataFrame, edges: DataFrame) -> DataFrame:
    """Make pairs open again."""
    return priors.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def forbidden_pairs(priors: DataFrame) -> DataFrame:
    """(a, b) with a < b that may not be joined in either direction."""
    f = priors.filter(F.col("status") == FORBIDDEN)
    return f.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.countDistinct("src").alias("k")).filter("k = 2").select("a", "b")


def admissible(candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """Candidate edges that are not forbidden."""
    return candidates.join(priors.filter(F.col("status") == FORBIDDEN).select("src", "dst"), ["src", "dst"], "left_anti")


def apply_priors(edges: DataFrame, priors: DataFrame) -> DataFrame:
    """edges with the required ones added and the forbidden ones taken away."""
    wanted = priors.filter(F.col("status") == REQUIRED).select("src", "dst")
    return admissible(edges.select("src", "dst").union(wanted).distinct(), priors)


def full_matrix(priors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, status) for every ordered pair: -1 where open, 0 on the diagonal."""
    n = nodes.select(F.col(nodes.columns[0]).alias("src"))
    every = n.join(n.select(F.col("src").alias("dst")), F.lit(True))
    return every.join(priors, ["src", "dst"], "left").select("src", "dst", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.coalesce("status", F.lit(-1))).alias("status"))
