"""Learners as queries: what each finds in the driver's tables, as edges."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import independence, lowrank
from causeway.operators.frame import event_seconds
from causeway.plans import base, cam, constraint, continuous, deep, hawkes, lingam, neural, pairwise, policy, score, tape  # noqa: F401  (they register learners)
from causeway.plans.queries import _TERMS, PER_ORDER, _power_sql, per_order, query, table

NAMES = ["c", "q", "e", "t"]


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.operators.frame import standardise

    return standardise(per_order(spark, sf_dir), NAMES)


def _add(name: str, learner: str, standard: bool, **options) -> None:
    def learn(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _standard(spark, sf_dir) if standard else per_order(spark, sf_dir)
        g = base.make(learner, **options).learn(rows, NAMES)
        return g.edges(spark).select("src_name", "dst_name", F.round("weight", 3).alias("weight"))

    learn.__name__ = name
    query()(learn)


_add("learn_pc", "pc", False, alpha=0.005)
_add("learn_pc_parallel", "pc", False, alpha=0.005, variant="parallel")
_add("learn_ges_bic", "ges", False)
_add("learn_ges_r2", "ges", False, method="r2")
_add("learn_direct_lingam", "directlingam", True, threshold=0.1)
_add("learn_ica_lingam", "icalingam", True, threshold=0.1)
_add("learn_notears", "notears", True, lambda1=0.01, threshold=0.1)
_add("learn_notears_low_rank", "notearslowrank", True, rank=2, threshold=0.1)
_add("learn_notears_basis", "notearsbasis", True, k=2, threshold=0.1)
_add("learn_golem", "golem", True, threshold=0.1)
_add("learn_masked_regression", "maskedregression", True)
_add("learn_order_search", "ordersearch", True, threshold=0.1)
_add("learn_notears_network", "notearsnetwork", True, threshold=0.2)
_add("learn_graph_autoencoder", "graphautoencoder", True)
_add("learn_graph_search", "graphsearch", True, threshold=0.1)
_add("learn_kernel_lingam", "directlingam", True, threshold=0.1, measure="kernel")
_add("learn_gran_dag", "grandag", True, threshold=0.1)
_add("learn_dag_gnn", "daggnn", True, threshold=0.1)


def _pc_sql(names: str, ctes: str, first: dict[str, str], then: dict[str, str]) -> str:
    """PC on three columns in SQL: first and then hold, for each pair, the condition under which it is independent
    at once, and given the third column. A pair is tested given a neighbour of its first column."""
    a, b, c = names
    ab, ac, bc = a + b, a + c, b + c
    test = ", ".join(f"{first[p]} AS i_{p}, {then[p]} AS j_{p}" for p in (ab, ac, bc))
    kept = f"NOT i_{ab} AND (i_{ac} OR NOT j_{ab}) AS k_{ab}, NOT i_{ac} AND (i_{ab} OR NOT j_{ac}) AS k_{ac}, NOT i_{bc} AND (i_{ab} OR NOT j_{bc}) AS k_{bc}"
    met = f"i_{bc} AND k_{ab} AND k_{ac} AS m_{a}, i_{ac} AND k_{ab} AND k_{bc} AS m_{b}, i_{ab} AND k_{ac} AND k_{bc} AS m_{c}"
    ways = ", ".join(f"{{s: '{x}', d: '{y}', k: k_{p} AND NOT m_{x}}}" for p in (ab, ac, bc) for x, y in (p, p[::-1]))
    return f"WITH {ctes}, t AS (SELECT {test} FROM v), g AS (SELECT *, {kept} FROM t), m AS (SELECT *, {met} FROM g), e AS (SELECT unnest([{ways}]) AS e FROM m) SELECT e.s AS src_name, e.d AS dst_name FROM e WHERE e.k"


def _fisher_sql(alpha_z: float) -> str:
    """learn_pc on three columns; alpha_z is the normal quantile of the level."""
    pairs = {"qe": "t", "qt": "e", "et": "q"}
    r = {p: f"r_{p}" for p in pairs}
    r |= {p[::-1]: f"r_{p}" for p in pairs}
    cors = ", ".join(f"corr({p[0]}, {p[1]}) AS r_{p}" for p in pairs)
    z = lambda x, k: f"abs(sqrt(n - {3 + k}) * 0.5 * ln((1 + {x}) / (1 - {x}))) <= {alpha_z}"
    partial = {p: f"(({r[p]} - {r[p[0] + c]} * {r[p[1] + c]}) / sqrt((1 - {r[p[0] + c]} ^ 2) * (1 - {r[p[1] + c]} ^ 2)))" for p, c in pairs.items()}
    return _pc_sql("qet", f"{PER_ORDER}, v AS (SELECT count(*) AS n, {cors} FROM per_order)", {p: z(r[p], 0) for p in pairs}, {p: z(x, 1) for p, x in partial.items()})


@query(_fisher_sql(2.807033768343811))
def learn_pc_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.make("pc", alpha=0.005).learn(per_order(spark, sf_dir), ["q", "e", "t"]).edges(spark).select("src_name", "dst_name")


#: Columns of lineitem where a and b meet in c: c is their sum, and one more for one line in ten.
_MET = "(SELECT l_linenumber % 2 AS a, l_suppkey % 3 AS b, l_linenumber % 2 + l_suppkey % 3 + (l_partkey % 10 = 0)::INTEGER AS c FROM lineitem)"


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber") % 2, F.col("l_suppkey") % 3
    return table(spark, sf_dir, "lineitem").select(a.alias("a"), b.alias("b"), (a + b + (F.col("l_partkey") % 10 == 0).cast("int")).alias("c"))


def _chi2_sql() -> str:
    #: 99 % points of chi-square with 1 to 16 degrees of freedom.
    points = [6.6349, 9.21034, 11.34487, 13.2767, 15.08627, 16.81189, 18.47531, 20.09024, 21.66599, 23.20925, 24.72497, 26.21697, 27.68825, 29.14124, 30.57791, 31.99993]
    pairs = {"ab": "c", "ac": "b", "bc": "a"}
    ctes = ", ".join(f"f_{p} AS ({_power_sql(_MET, *p, None, _TERMS['chi2'])}), s_{p} AS ({_power_sql(_MET, *p, z, _TERMS['chi2'])})" for p, z in pairs.items())
    row = ", ".join(f"(SELECT statistic <= ({points})[dof] FROM {k}_{p}) AS {k}_{p}" for p in pairs for k in "fs")
    return _pc_sql("abc", f"{ctes}, v AS (SELECT {row})", {p: f"f_{p}" for p in pairs}, {p: f"s_{p}" for p in pairs})


@query(_chi2_sql())
def learn_pc_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint.PC(test="chi2", alpha=0.01).learn(_met(spark, sf_dir), ["a", "b", "c"]).edges(spark).select("src_name", "dst_name")


@query()
def learn_ges_bdeu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.GES("bdeu").learn(_met(spark, sf_dir), ["a", "b", "c"]).edges(spark).select("src_name", "dst_name")


@query()
def learn_ttpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_seconds(table(spark, sf_dir, "events"), "ts").select(F.col("event_type").alias("event"), "timestamp", F.col("user_id").alias("node"))
    return hawkes.TTPM(delta=1e-4).learn(log).edges(spark).select("src_name", "dst_name")


#: Two clicks in three are followed by an echo of the same user, one to five minutes later.
_ECHOES = """SELECT event_type AS event, epoch(ts) AS t, user_id FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'echo', epoch(ts) + 60 + event_id % 240, user_id FROM events WHERE event_type = 'click' AND event_id % 3 < 2"""


@query(f"""WITH e AS ({_ECHOES}), span AS (SELECT max(t) - min(t) AS s FROM e),
found AS (SELECT a.event AS src_name, b.event AS dst_name, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t <= a.t + 600 GROUP BY ALL),
chance AS (SELECT a.event AS src_name, b.event AS dst_name, sum(a.n * b.n) * 600 / any_value(s) AS n FROM (SELECT event, user_id, count(*) AS n FROM e GROUP BY ALL) a JOIN (SELECT event, user_id, count(*) AS n FROM e GROUP BY ALL) b ON a.user_id = b.user_id, span GROUP BY ALL)
SELECT src_name, dst_name FROM chance LEFT JOIN found USING (src_name, dst_name) WHERE src_name = dst_name OR found.n > 10 + 3 * chance.n""")
def learn_ttpm_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL takes for an edge what follows within ten minutes far more often than by chance; every event has its self loop."""
    events = event_seconds(table(spark, sf_dir, "events"), "ts")
    own = events.filter(F.col("event_type").isin("click", "view")).select(F.col("event_type").alias("event"), "timestamp", F.col("user_id").alias("node"))
    echo = events.filter((F.col("event_type") == "click") & (F.col("event_id") % 3 < 2)).select(F.lit("echo").alias("event"), (F.col("timestamp") + 60 + F.col("event_id") % 240).alias("timestamp"), F.col("user_id").alias("node"))
    return hawkes.TTPM(delta=5e-3).learn(own.union(echo)).edges(spark).select("src_name", "dst_name")


@query()
def bootstrap_lingam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standard(spark, sf_dir).persist()
    found = lingam.bootstrap(rows, NAMES, ["l_orderkey"], 10, lingam.DirectLiNGAM(threshold=0.05))
    return lingam.median_effects(found, 10).select("src", "dst", F.round("effect", 3).alias("effect"), F.round("probability", 3).alias("probability"))


def _customer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a balance; e, a curve of it with noise that a hash draws; p, a bent sum of it and noise; f, a hash alone."""
    draw = lambda k: F.pmod(F.xxhash64("c_custkey", F.lit(k)), F.lit(10**6)) / 10**6 - 0.5
    a = F.col("c_acctbal") / 5000 - 1
    return table(spark, sf_dir, "customer").select(a.alias("a"), (F.tanh(3 * a) + 0.6 * draw(1)).alias("e"), F.sinh(2 * F.tanh(a) + draw(2)).alias("p"), draw(3).alias("f"))


@query()
def learn_anm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.ANM(alpha=0.01).learn(_customer_pairs(spark, sf_dir), ["a", "e", "f"]).edges(spark).select("src_name", "dst_name")


@query()
def learn_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.PNL(decide="one").learn(_customer_pairs(spark, sf_dir), ["a", "p", "f"]).edges(spark).select("src_name", "dst_name")


def _ges_sql(names: str) -> str:
    """The class of the graph on three columns of PER_ORDER with the largest BIC, of all 25."""
    pairs, dags = [(0, 1), (0, 2), (1, 2)], []
    for ways in product((0, 1, 2), repeat=3):
        edges = [(i, j) if w == 1 else (j, i) for (i, j), w in zip(pairs, ways, strict=True) if w]
        if set(edges) not in ({(0, 1), (1, 2), (2, 0)}, {(1, 0), (2, 1), (0, 2)}):
            dags.append(edges)

    def left(y: int, parents: list[int]) -> str:
        v, r = f"var_pop_{names[y]}", [f"r_{names[min(y, p)]}{names[max(y, p)]}" for p in parents]
        if len(parents) == 2:
            c = f"r_{names[parents[0]]}{names[parents[1]]}"
            return f"{v} * (1 - ({r[0]} ^ 2 + {r[1]} ^ 2 - 2 * {r[0]} * {r[1]} * {c}) / (1 - {c} ^ 2))"
        return f"{v} * (1 - {r[0]} ^ 2)" if r else v

    rows = []
    for edges in dags:
        of = [sorted(i for i, j in edges if j == y) for y in range(3)]
        score = " + ".join(f"-(n * (1 + ln({left(y, of[y])})) + {1 + len(of[y])} * ln(n))" for y in range(3))
        met = [(i, j) for i, j in edges if any(k != i and m == j and (i, k) not in edges and (k, i) not in edges for k, m in edges)]
        lines = edges if met else edges + [(j, i) for i, j in edges]
        rows.append(f"{{s: {score}, e: [{', '.join(f'{{a: {names[i]!r}, b: {names[j]!r}}}' for i, j in lines)}]{'' if lines else '::STRUCT(a VARCHAR, b VARCHAR)[]'}}}")
    cors = ", ".join(f"corr({names[i]}, {names[j]}) AS r_{names[i]}{names[j]}" for i, j in pairs)
    return f"WITH {PER_ORDER}, v AS (SELECT count(*) AS n, {cors}, {', '.join(f'var_pop({c}) AS var_pop_{c}' for c in names)} FROM per_order), g AS (SELECT unnest([{', '.join(rows)}]) AS g FROM v), best AS (SELECT g.e AS e FROM g ORDER BY g.s DESC LIMIT 1), x AS (SELECT unnest(e) AS x FROM best) SELECT x.a AS src_name, x.b AS dst_name FROM x"


@query(_ges_sql("qet"))
def learn_ges_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.GES().learn(per_order(spark, sf_dir), ["q", "e", "t"]).edges(spark).select("src_name", "dst_name")


def _lingam_sql(x: str, y: str) -> str:
    """The direction whose cause and residual have the smaller entropies; the residuals are standardised."""
    #: Fixed values of the entropy approximation.
    h = lambda u: f"((1 + ln(2 * pi())) / 2 - 79.047 * (avg(abs({u}) + ln(1 + exp(-2 * abs({u}))) - ln(2)) - 0.37457) ^ 2 - 7.4129 * avg({u} * exp(-(({u}) ^ 2) / 2)) ^ 2)"
    return f"""WITH {PER_ORDER}, s AS (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx, avg({y}) AS my, stddev_pop({y}) AS sy, corr({x}, {y}) AS r FROM per_order),
z AS (SELECT ({x} - mx) / sx AS a, ({y} - my) / sy AS b, r FROM per_order, s), u AS (SELECT a, b, (a - r * b) / sqrt(1 - r ^ 2) AS ab, (b - r * a) / sqrt(1 - r ^ 2) AS ba FROM z),
h AS (SELECT {h("b")} + {h("ab")} - {h("a")} - {h("ba")} AS gap FROM u)
SELECT CASE WHEN gap > 0 THEN '{x}' ELSE '{y}' END AS src_name, CASE WHEN gap > 0 THEN '{y}' ELSE '{x}' END AS dst_name FROM h"""


@query(_lingam_sql("q", "e"))
def learn_lingam_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lingam.DirectLiNGAM(threshold=0.1).learn(_standard(spark, sf_dir), ["q", "e"]).edges(spark).select("src_name", "dst_name")


_add("learn_rl", "rl", True, threshold=0.1)
_add("learn_corl", "corl", True, threshold=0.1)
_add("learn_cam", "cam", False)
_add("learn_mcsl", "mcsl", True)
_add("learn_notears_mlp", "notearsmlp", True, threshold=0.2)
_add("learn_gran_dag_selected", "grandag", True, threshold=0.1, neighbours=2, holdout=0.2, cutoff=0.001, layers=2)
_add("learn_dag_gnn_sem", "daggnn", True, threshold=0.1, form="sem")


@query()
def learn_vector_autoencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda c: F.array(F.col(c), F.sqrt(c))
    rows = per_order(spark, sf_dir).select(pair("c").alias("lines"), pair("q").alias("quantity"), pair("t").alias("total"))
    return tape.VectorAutoencoder().learn(rows, ["lines", "quantity", "total"]).edges(spark).select("src_name", "dst_name", F.round("weight", 3).alias("weight"))


@query()
def process_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length scale and noise of largest likelihood for e on a, and what the curve leaves of the variance."""
    rows = _customer_pairs(spark, sf_dir)
    g = lowrank.fit_process(rows, ["a"], "e")
    left = lowrank.process_residual(rows, "a", "e", widths=(g.basis.width,), noise=g.noise)
    return left.agg(F.round(F.var_pop("residual"), 3).alias("left")).withColumn("width", F.lit(g.basis.width)).withColumn("noise", F.round(F.lit(g.noise), 6))


@query("""WITH s AS (SELECT (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS y, s_suppkey AS i FROM supplier),
g AS (SELECT a.i, b.i AS j, (a.x - b.x) ^ 2 AS gx, (a.y - b.y) ^ 2 AS gy FROM s a, s b),
w AS (SELECT median(gx) FILTER (WHERE i < j AND gx > 0) AS wx, median(gy) FILTER (WHERE i < j AND gy > 0) AS wy FROM g),
k AS (SELECT i, j, exp(-gx / wx) AS kx, exp(-gy / wy) AS ky FROM g, w),
c AS (SELECT (kx - avg(kx) OVER (PARTITION BY i) - avg(kx) OVER (PARTITION BY j) + avg(kx) OVER ()) * (ky - avg(ky) OVER (PARTITION BY i) - avg(ky) OVER (PARTITION BY j) + avg(ky) OVER ()) AS p FROM k)
SELECT round(sum(p) / (SELECT count(*) FROM supplier), 3) AS statistic FROM c""")
def hsic_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = independence.hsic_test(table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey")
    return spark.range(1).select(F.round(F.lit(found["statistic"]), 3).alias("statistic"))


@query()
def simulate_linear_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.sources import simulate

    return simulate.sample(spark, simulate.random_dag("erdos_renyi", 6, 8, 1), 500, seed=1)


@query()
def simulate_causal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.sources import series

    return series.causal_series(spark, 20, 64)


@query("SELECT a.i::DOUBLE AS angle, l.j::DOUBLE AS light FROM range(-40, 44) a(i), range(60, 148) l(j) WHERE l.j <> 100")
def pendulum_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.sources import simulate

    return simulate.pendulum(spark).select("angle", "light")


@query("""WITH s AS (SELECT user_id AS series, list(value::DOUBLE ORDER BY ts, value) AS v FROM events GROUP BY user_id),
k AS (SELECT series, v, unnest(range(1, 5)) AS k FROM s)
SELECT series, k::INTEGER AS k, list_resize(v[-least(k, len(v)):], 4, 0.0) AS segment FROM k""")
def growing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.operators import frame

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.struct("ts", "value").alias("o"), "value")
    long = frame.segments(e, "u", "o", ["value"], 4).select("series", F.posexplode("segments").alias("k", "segment"))
    return long.select("series", (F.col("k") + 1).alias("k"), "segment")


_REPLICATES = "r AS (SELECT l_suppkey % 10 AS replicate, l_returnflag AS src, l_linestatus AS dst, regr_slope(l_extendedprice, l_quantity) AS weight, regr_slope(l_quantity, l_extendedprice) AS effect FROM lineitem GROUP BY ALL)"


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("replicate", F.col("l_suppkey") % 10)
    return rows.groupBy("replicate", F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("dst")).agg(F.regr_slope("l_extendedprice", "l_quantity").alias("weight"), F.regr_slope("l_quantity", "l_extendedprice").alias("effect"))


@query(f"WITH {_REPLICATES} SELECT src, dst, sign(weight)::INTEGER AS sign, count(DISTINCT replicate) AS n FROM r WHERE abs(weight) > 5 GROUP BY ALL")
def bootstrap_direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lingam.direction_counts(_replicates(spark, sf_dir), 5, signs=True)


@query(f"WITH {_REPLICATES}, g AS (SELECT replicate, list_sort(list_distinct(list(src || dst))) AS graph FROM r WHERE abs(weight) > 5 GROUP BY replicate) SELECT len(graph)::BIGINT AS size, count(*) AS n FROM g GROUP BY graph")
def bootstrap_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lingam.graph_counts(_replicates(spark, sf_dir), 5).select(F.size("graph").cast("long").alias("size"), "n")


@query(f"WITH {_REPLICATES} SELECT src, dst, round(count(DISTINCT replicate) / 10, 4) AS probability FROM r WHERE abs(weight) > 5 GROUP BY ALL")
def bootstrap_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lingam.edge_probabilities(_replicates(spark, sf_dir), 10, 5).select("src", "dst", F.round("probability", 4).alias("probability"))


@query(f"WITH {_REPLICATES} SELECT src, dst, round(median(effect), 6) AS effect, round(count(DISTINCT replicate) / 10, 4) AS probability FROM r GROUP BY ALL")
def bootstrap_median_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lingam.median_effects(_replicates(spark, sf_dir), 10).select("src", "dst", F.round("effect", 6).alias("effect"), F.round("probability", 4).alias("probability"))
