"""Graphs as edge tables (src, dst[, weight]); an undirected edge stands in both directions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only for a session on one machine that has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def _local(df: DataFrame) -> DataFrame:
    """Cut the plan between the rounds of a traversal, in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, or other entries of a matrix, whose row and column are both none of the nodes."""
    gone = nodes.select(F.col(nodes.columns[0]).alias("_gone")).distinct()
    return edges.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")


def from_matrix_rows(matrix: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """Edges (src, dst, weight) of a wide adjacency table: one row a node, one column a target."""
    cells = F.array(*[F.struct(F.lit(c).alias("dst"), F.col(f"`{c}`").cast("double").alias("weight")) for c in columns])
    return matrix.select(F.col(f"`{node}`").alias("src"), F.inline(cells)).filter("weight <> 0")


def to_matrix_rows(edges: DataFrame, nodes: DataFrame, names: list) -> DataFrame:
    """One row a node of nodes, one 0/1 column a name."""
    wide = edges.groupBy("src").agg(*[F.max(F.when(F.col("dst") == F.lit(n), 1).otherwise(0)).alias(str(n)) for n in names])
    return nodes.select(F.col(nodes.columns[0]).alias("src")).join(wide, "src", "left").na.fill(0)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def skeleton(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b of all adjacent pairs."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def typed(edges: DataFrame) -> DataFrame:
    """(a, b, kind) with a < b: 'forward' a -> b, 'backward' b -> a, 'undirected' both; loops left out."""
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.countDistinct("src").alias("k"), F.min("src").alias("s")).select("a", "b", F.when(F.col("k") == 2, "undirected").when(F.col("s") == F.col("a"), "forward").otherwise("backward").alias("kind"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more; doubling, so rounds are logarithmic in the longest path."""
    reach = _local(edges.select("src", "dst").distinct())
    n = reach.count()
    while True:
        hop = reach.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        reach = _local(reach.union(reach.join(hop, F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst"))).distinct())
        if (now := reach.count()) == n:
            return reach
        n = now


def is_dag(edges: DataFrame) -> DataFrame:
    """One row (n_edges, on_cycles, is_dag)."""
    loops = closure(edges).agg(F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("int")), F.lit(0)).cast("long").alias("on_cycles"))
    return loops.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).select("n_edges", "on_cycles", (F.col("on_cycles") == 0).alias("is_dag"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level) of a DAG: the longest path that ends at the node. Nodes on or after a cycle are left out."""
    left = _local(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    open_edges = edges.select("src", "dst").distinct()
    done = None
    level = 0
    while left.limit(1).count():
        blocked = open_edges.join(left.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        roots = left.join(blocked, "node", "left_anti")
        if not roots.limit(1).count():
            break
        step = roots.withColumn("level", F.lit(level))
        done = _local(step if done is None else done.union(step))
        left = _local(left.join(roots, "node", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def k_hop_ring(edges: DataFrame, k: int) -> DataFrame:
    """(node, hop, neighbour) for hops 0..k of an undirected graph: nodes whose shortest path has exactly that length."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    nodes = both.select(F.col("src").alias("node")).distinct()
    ring = seen = _local(nodes.select("node", F.lit(0).alias("hop"), F.col("node").alias("neighbour")))
    for hop in range(1, k + 1):
        step = ring.join(both, F.col("neighbour") == F.col("src")).select("node", F.col("dst").alias("neighbour")).distinct()
        ring = _local(step.join(seen.select("node", "neighbour"), ["node", "neighbour"], "left_anti").select("node", F.lit(hop).alias("hop"), "neighbour"))
        seen = seen.union(ring)
    return seen


def v_structures(edges: DataFrame, sepsets: DataFrame) -> DataFrame:
    """(i, k, j) with i < j: i and j separated without k, k adjacent to both. sepsets: (i, j, sepset array)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seps = sepsets.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sepset")
    near_i = both.select(F.col("src").alias("i"), F.col("dst").alias("k"))
    near_j = both.select(F.col("src").alias("j"), F.col("dst").alias("k"))
    return seps.join(near_i, "i").join(near_j, ["j", "k"]).filter(~F.array_contains("sepset", F.col("k"))).select("i", "k", "j").distinct()


def drop_arrows(edges: DataFrame, arrows: DataFrame) -> DataFrame:
    """edges without the given (src, dst), where the opposite direction is there too."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    two_way = arrows.select("src", "dst").distinct().join(back, ["src", "dst"], "left_semi")
    return edges.join(two_way, ["src", "dst"], "left_anti")


def orient_v_structures(edges: DataFrame, sepsets: DataFrame) -> DataFrame:
    v = v_structures(edges, sepsets)
    out = v.select(F.col("k").alias("src"), F.col("i").alias("dst")).union(v.select(F.col("k").alias("src"), F.col("j").alias("dst")))
    return drop_arrows(edges, out)


def meek_arrows(edges: DataFrame, rule: int) -> DataFrame:
    """Undirected edges (src, dst) that Meek's rule 1 to 4 turns into src -> dst.

    1: k -> src, k not adjacent to dst. 2: src -> k -> dst. 3: src - k -> dst and
    src - l -> dst, k and l not adjacent. 4: src - k -> l -> dst, k and dst not
    adjacent.
    """
    e = _local(edges.select("src", "dst").distinct())
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    lines = e.join(back, ["src", "dst"], "left_semi")
    arrows = e.join(back, ["src", "dst"], "left_anti")
    near = e.union(back).distinct()

    def named(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.col("src").alias(a), F.col("dst").alias(b))

    goal = named(lines, "i", "j")
    if rule == 1:
        found = goal.join(named(arrows, "k", "i"), "i").filter("k <> j").join(named(near, "k", "j"), ["k", "j"], "left_anti")
    elif rule == 2:
        found = goal.join(named(arrows, "i", "k"), "i").join(named(arrows, "k", "j"), ["k", "j"])
    elif rule == 3:
        one = goal.join(named(lines, "i", "k"), "i").join(named(arrows, "k", "j"), ["k", "j"])
        two = one.withColumnRenamed("k", "l")
        found = one.join(two, ["i", "j"]).filter("k < l").join(named(near, "k", "l"), ["k", "l"], "left_anti")
    elif rule == 4:
        found = goal.join(named(lines, "i", "k"), "i").join(named(arrows, "k", "l"), "k").join(named(arrows, "l", "j"), ["l", "j"]).filter("k <> j").join(named(near, "k", "j"), ["k", "j"], "left_anti")
    else:
        raise ValueError("rule must be 1 to 4")
    return found.select(F.col("i").alias("src"), F.col("j").alias("dst")).distinct()


def meek(edges: DataFrame) -> DataFrame:
    """All four rules until none applies."""
    edges = _local(edges.select("src", "dst").distinct())
    n = edges.count()
    while True:
        for rule in (1, 2, 3, 4):
            edges = _local(drop_arrows(edges, _one_way(reverse(meek_arrows(edges, rule)))))
        if (now := edges.count()) == n:
            return edges
        n = now


def _one_way(arrows: DataFrame) -> DataFrame:
    """Of arrows asked for in both directions, one."""
    return arrows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("src", "dst")).alias("e")).select("e.src", "e.dst")


def cpdag(dag: DataFrame) -> DataFrame:
    """Edges of the equivalence class of a DAG: its v-structures, closed under Meek's rules; the rest undirected."""
    e = dag.select("src", "dst").distinct()
    near = e.union(reverse(e)).distinct()
    pairs = e.select(F.col("src").alias("i"), F.col("dst").alias("k")).join(e.select(F.col("src").alias("j"), F.col("dst").alias("k")), "k").filter("i < j")
    open_pairs = pairs.join(near.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_anti")
    fixed = open_pairs.select(F.col("i").alias("src"), F.col("k").alias("dst")).union(open_pairs.select(F.col("j").alias("src"), F.col("k").alias("dst"))).distinct()
    return meek(near.join(reverse(fixed), ["src", "dst"], "left_anti"))


def order_to_graph(order: Column | str, df: DataFrame) -> DataFrame:
    """(src, dst) of the complete DAG of an array column that lists nodes from first to last."""
    col = F.col(order) if isinstance(order, str) else order
    places = df.select(F.posexplode(col).alias("p", "node"))
    a, b = places.select(F.col("p").alias("pa"), F.col("node").alias("src")), places.select(F.col("p").alias("pb"), F.col("node").alias("dst"))
    return a.join(b, F.col("pa") < F.col("pb")).select("src", "dst")


def cover_rate(true_edges: DataFrame, full: DataFrame) -> DataFrame:
    """One row: the share of true edges that a complete DAG has in their direction."""
    hit = full.select("src", "dst").withColumn("hit", F.lit(1))
    return true_edges.join(hit, ["src", "dst"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("cover_rate"))


def prune(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.abs("weight") > threshold)


def threshold_to_dag(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Drop edges of least weight, all of one magnitude at a time, until no cycle is left.

    The cut is found by bisection over the distinct magnitudes, so a graph of m
    weights needs about log2(m) closures.
    """
    edges = _local(prune(edges, threshold))
    cuts = edges.select(F.abs("weight").alias("w")).distinct().orderBy("w").collect()
    low, high = 0, len(cuts)  # cutting everything up to cuts[high - 1] surely leaves a DAG
    while low < high:
        mid = (low + high) // 2
        kept = edges.filter(F.abs("weight") > (cuts[mid - 1]["w"] if mid else -1.0))
        low, high = (low, mid) if is_dag(kept).first()["is_dag"] else (mid + 1, high)
    return edges.filter(F.abs("weight") > (cuts[low - 1]["w"] if low else -1.0))


def graph_number(edges: DataFrame, d: int) -> DataFrame:
    """(src, number): each row of a 0/1 matrix of up to 63 columns read as a binary number, first column highest."""
    return edges.filter("weight <> 0" if "weight" in edges.columns else "true").groupBy("src").agg(F.sum(F.expr(f"shiftleft(1L, {d - 1} - cast(dst as int))")).alias("number"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) in the skeleton."""
    s = skeleton(edges)
    return s.select(F.col("a").alias("node")).union(s.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def longest_path_rank(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, position): a topological order; nodes of one level by name."""
    return levels(edges, nodes).select("node", (F.row_number().over(W.Window.orderBy("level", "node")) - 1).alias("position"))
