"""Queries on the driver's tables, one or more for each operator, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import columns as C
from causeway.operators import frame, graph, independence, metrics, moments, priors, scores
from causeway.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, *keep: str) -> DataFrame:
    """Doubles rounded, so that the order of a distributed sum does not show."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c lines, q quantity, e price and t total of every order that has lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("t"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "c", "q", "e", "t")


PER_ORDER = "per_order AS (SELECT l_orderkey, count(*)::DOUBLE AS c, sum(l_quantity) AS q, sum(l_extendedprice) AS e, any_value(o_totalprice) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- independence ------------------------------------------------------------


@query("""WITH r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem),
p AS (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM r)
SELECT n, round(r, 4) AS r, round(sqrt(n - 4) * 0.5 * ln((1 + r) / (1 - r)), 4) AS statistic FROM p""")
def ci_fisherz_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(independence.fisherz_statistic(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"))


@query(f"WITH {PER_ORDER} SELECT count(*) AS n, round(corr(c, q), 4) AS r, round(sqrt(count(*) - 3) * 0.5 * ln((1 + corr(c, q)) / (1 - corr(c, q))), 4) AS statistic FROM per_order")
def ci_fisherz_order0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(independence.fisherz_statistic(per_order(spark, sf_dir), "c", "q"))


@query(f"""WITH {PER_ORDER}, long AS (SELECT unnest([{{a: 'c', b: 'q', r: corr(c, q)}}, {{a: 'c', b: 'e', r: corr(c, e)}}, {{a: 'c', b: 't', r: corr(c, t)}}, {{a: 'q', b: 'e', r: corr(q, e)}}, {{a: 'q', b: 't', r: corr(q, t)}}, {{a: 'e', b: 't', r: corr(e, t)}}]) AS x, count(*) AS n FROM per_order)
SELECT x.a, x.b, round(sqrt(n - 3) * 0.5 * ln((1 + x.r) / (1 - x.r)), 3) AS statistic FROM long""")
def ci_fisherz_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_order(spark, sf_dir)
    names = ["c", "q", "e", "t"]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C.fisher_z(F.corr(a, b), F.count(F.lit(1)), 0).alias("statistic")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return rounded(rows.agg(F.array(*cells).alias("x")).select(F.inline("x")), 3)


def _power_sql(source: str, x: str, y: str, z: str | None, term: str) -> str:
    part = "PARTITION BY g.z" if z else ""
    join = "c.z = g.z AND " if z else ""
    sep = "," if z else ""
    return f"""WITH rows AS (SELECT {f'{z} AS z,' if z else ''} {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
cells AS (SELECT {'z,' if z else ''} x, y, count(*)::DOUBLE AS o FROM rows GROUP BY ALL),
xs AS (SELECT {'z,' if z else ''} x, sum(o) AS nx FROM cells GROUP BY ALL), ys AS (SELECT {'z,' if z else ''} y, sum(o) AS ny FROM cells GROUP BY ALL),
grid AS (SELECT {'xs.z,' if z else ''} x, y, nx, ny, sum(nx) OVER (PARTITION BY y {sep}{' xs.z' if z else ''}) AS n FROM xs JOIN ys ON {'xs.z = ys.z' if z else 'true'}),
full_grid AS (SELECT {'g.z,' if z else ''} g.x, g.y, coalesce(c.o, 0) AS o, g.nx * g.ny / g.n AS e, (count(DISTINCT g.x) OVER ({part}) - 1) * (count(DISTINCT g.y) OVER ({part}) - 1) AS dof FROM grid g LEFT JOIN cells c ON {join} c.x = g.x AND c.y = g.y),
terms AS (SELECT {'z,' if z else ''} dof, CASE WHEN dof = 1 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END AS o, e FROM full_grid WHERE dof > 0),
strata AS (SELECT {'z,' if z else ''} dof, sum({term}) AS s FROM terms GROUP BY ALL)
SELECT round(coalesce(sum(s), 0), 4) AS statistic, coalesce(sum(dof), 0)::BIGINT AS dof FROM strata"""


#: A cell's term in SQL for each member of the family; the tables below have no empty cells where a power is negative.
_TERMS = {
    "chi2": "(o - e) * (o - e) / e",
    "g2": "CASE WHEN o = 0 THEN 0 ELSE 2 * o * ln(o / e) END",
    "freeman_tukey": "o * (pow(o / e, -0.5) - 1) / (0.5 * -0.5 * 0.5)",
    "modify_log_likelihood": "2 * e * ln(e / o)",
    "neyman": "o * (pow(o / e, -2) - 1) / (0.5 * -2 * -1)",
    "cressie_read": "CASE WHEN o = 0 THEN 0 ELSE o * (pow(o / e, 2.0 / 3) - 1) / (0.5 * (2.0 / 3) * (5.0 / 3)) END",
}


def _add_power(name: str) -> None:
    def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(independence.power_divergence(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["l_linenumber"], name))

    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(independence.power_divergence(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", [], name))

    conditional.__name__, plain.__name__ = f"ci_{name}_given", f"ci_{name}"
    query(_power_sql("lineitem", "l_returnflag", "l_linestatus", "l_linenumber", _TERMS[name]))(conditional)
    query(_power_sql("orders", "o_orderstatus", "o_orderpriority", None, _TERMS[name]))(plain)


for _name in _TERMS:
    _add_power(_name)


@query(_power_sql("labels", "quality", "toxic", None, _TERMS["chi2"]))
def ci_chi2_yates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(independence.power_divergence(table(spark, sf_dir, "labels"), "quality", "toxic", [], "chi2"))


# --- moments, scores ---------------------------------------------------------


def _matrix_sql(kind: str) -> str:
    return "WITH x AS (SELECT unnest([" + ", ".join(f"{{a: '{a}', b: '{b}', v: {kind}({a}, {b})}}" for a in NUMBERS for b in NUMBERS) + "]) AS s FROM lineitem) SELECT s.a, s.b, round(s.v, 3) AS value FROM x"


@query(_matrix_sql("covar_pop"))
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.matrix_long(table(spark, sf_dir, "lineitem"), NUMBERS), 3)


@query(_matrix_sql("corr"))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.matrix_long(table(spark, sf_dir, "lineitem"), NUMBERS, "corr"), 3)


@query(f"WITH {PER_ORDER} SELECT count(*) AS n, round(-(count(*) * (1 + ln(var_pop(q))) + ln(count(*))), 2) AS score FROM per_order")
def bic_no_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.bic_frame(per_order(spark, sf_dir), "q"), 2)


@query(f"WITH {PER_ORDER} SELECT count(*) AS n, round(-(count(*) * (1 + ln(var_pop(q) - pow(covar_pop(q, c), 2) / var_pop(c))) + 2 * ln(count(*))), 2) AS score FROM per_order")
def bic_one_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.bic_frame(per_order(spark, sf_dir), "q", "c"), 2)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_ijk FROM lineitem GROUP BY ALL")
def bdeu_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.BDeu(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).counts(1, [0])


@query("""WITH cells AS (SELECT l_returnflag AS j, l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY ALL),
shape AS (SELECT count(DISTINCT l_linestatus)::DOUBLE AS r, count(DISTINCT l_returnflag)::DOUBLE AS q FROM lineitem),
js AS (SELECT j, sum(n) AS nj, sum(lgamma(n + 10 / (r * q)) - lgamma(10 / (r * q))) AS s FROM cells, shape GROUP BY j)
SELECT round((any_value(r) - 1) * any_value(q) * ln(0.001) + sum(lgamma(10 / q) - lgamma(nj + 10 / q) + s), 3) AS score FROM js, shape""")
def bdeu_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.BDeu(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(round(found.of(1, [0]), 3),)], "score double")


@query(f"WITH {PER_ORDER} SELECT round(regr_slope(q, c), 4) AS effect, round(regr_r2(q, c), 4) AS r2 FROM per_order")
def total_effect_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_order(spark, sf_dir)
    return rounded(rows.agg(F.regr_slope("q", "c").alias("effect"), F.regr_r2("q", "c").alias("r2")))


@query(f"""WITH {PER_ORDER}, s AS (SELECT var_pop(c) AS cc, var_pop(q) AS qq, covar_pop(c, q) AS cq, covar_pop(c, e) AS ce, covar_pop(q, e) AS qe FROM per_order)
SELECT round((qe * cc - ce * cq) / (qq * cc - cq * cq), 3) AS effect FROM s""")
def total_effect_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.moments(per_order(spark, sf_dir), ["c", "q", "e"])
    return spark.createDataFrame([(round(scores.total_effect(m, 1, 2, [0]), 3),)], "effect double")


@query(f"WITH {PER_ORDER} SELECT round(ln((regr_syy(q, c) * (1 - regr_r2(q, c)) + regr_sxx(q, c)) / count(*) + 1e-8) + ln(count(*)) / (count(*) * 2), 5) AS reward FROM per_order")
def graph_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    m = moments.moments(per_order(spark, sf_dir), ["c", "q"])
    return spark.createDataFrame([(round(float(scores.graph_reward(m, np.array([[0, 1], [0, 0]]))), 5),)], "reward double")


@query(f"""WITH {PER_ORDER}, u AS (SELECT (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS u FROM per_order),
a AS (SELECT avg(ln((exp(u) + exp(-u)) / 2)) AS lc, avg(u * exp(-u * u / 2)) AS xg FROM u)
SELECT round((1 + ln(2 * pi())) / 2 - 79.047 * pow(lc - 0.37457, 2) - 7.4129 * pow(xg, 2), 4) AS entropy FROM a""")
def entropy_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame.standardise(per_order(spark, sf_dir), ["q"])
    means = u.agg(F.avg(C.log_cosh(F.col("q"))).alias("a"), F.avg(C.x_gauss(F.col("q"))).alias("b"))
    return rounded(means.select(C.entropy_of(F.col("a"), F.col("b")).alias("entropy")))


@query(f"WITH {PER_ORDER} SELECT round(var_pop(r), 3) AS variance, round(avg(r), 3) AS mean FROM (SELECT q - (SELECT covar_samp(q, c) / var_pop(c) FROM per_order) * c AS r FROM per_order)")
def regression_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.residual(per_order(spark, sf_dir), "q", "c").agg(F.var_pop("residual").alias("variance"), F.avg("residual").alias("mean")), 3)


@query(f"WITH {PER_ORDER} SELECT l_orderkey, round((q - avg(q) OVER ()) / stddev_pop(q) OVER (), 6) AS q, round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 6) AS e FROM per_order")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.standardise(per_order(spark, sf_dir), ["q", "e"]).select("l_orderkey", "q", "e"), 6)


@query(f"WITH {PER_ORDER} SELECT l_orderkey, round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 6) AS q FROM per_order")
def standardised_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.standardise(per_order(spark, sf_dir), ["q"], sample=True).select("l_orderkey", "q"), 6)


@query(f"WITH {PER_ORDER} SELECT l_orderkey, round(q - avg(q) OVER (), 4) AS q FROM per_order")
def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.centre(per_order(spark, sf_dir), ["q"]).select("l_orderkey", "q"))


@query(f"WITH {PER_ORDER} SELECT l_orderkey, round(c / greatest(sqrt(c * c + q * q), 1e-12), 6) AS c, round(q / greatest(sqrt(c * c + q * q), 1e-12), 6) AS q FROM per_order")
def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.unit_rows(per_order(spark, sf_dir).select("l_orderkey", "c", "q"), ["c", "q"]), 6)


@query(f"WITH {PER_ORDER} SELECT l_orderkey, 1.0::DOUBLE AS one, c, q, c * c AS c_c, round(c * q, 2) AS c_q, round(q * q, 2) AS q_q FROM per_order")
def degree_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(per_order(spark, sf_dir).select("l_orderkey", *C.degree_two(["c", "q"])), 2)


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount - l_tax) * 10)), 6) AS p, round(tanh(l_discount) + cos(l_tax) + sin(l_quantity) + l_discount, 6) AS m FROM lineitem")
def structural_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    p = C.sigmoid((F.col("l_discount") - F.col("l_tax")) * 10)
    m = C.mixed_index_model(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_discount"))
    return rounded(x.select("l_orderkey", "l_linenumber", p.alias("p"), m.alias("m")), 6)


@query("""WITH s AS (SELECT s_suppkey, [s_acctbal / 10000, (s_suppkey % 7) / 7.0, (s_suppkey % 3) / 2.0]::DOUBLE[] AS x FROM supplier),
d AS (SELECT s_suppkey, x, list_reverse_sort(x) AS y FROM s),
k AS (SELECT s_suppkey, x, y, CASE WHEN 1 + 3 * y[3] > y[1] + y[2] + y[3] THEN 3 WHEN 1 + 2 * y[2] > y[1] + y[2] THEN 2 ELSE 1 END AS k FROM d),
t AS (SELECT s_suppkey, x, (list_sum(y[1:k]) - 1) / k AS t FROM k)
SELECT s_suppkey, round(greatest(x[1] - t, 0), 6) AS a, round(greatest(x[2] - t, 0), 6) AS b, round(greatest(x[3] - t, 0), 6) AS c FROM t""")
def sparsemax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    x = F.array(F.col("s_acctbal") / 10000, (key % 7) / 7.0, (key % 3) / 2.0)
    p = table(spark, sf_dir, "supplier").select("s_suppkey", C.sparsemax(x).alias("p"))
    return rounded(p.select("s_suppkey", *[F.element_at("p", i + 1).alias(n) for i, n in enumerate("abc")]), 6)


# --- frames and events -------------------------------------------------------


@query("SELECT floor(epoch(ts) / 86400)::BIGINT AS bin, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def alarm_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.window_counts(table(spark, sf_dir, "events"), "event_type", C.epoch(F.col("ts")), 86400)


def _event_types(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]


@query("""SELECT bin, sum(n) AS total, max(n) AS most, count(*) FILTER (n > 0) AS kinds FROM (
SELECT floor(epoch(ts) / 300)::BIGINT AS bin, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY bin""")
def alarm_window_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _event_types(spark, sf_dir)
    wide = frame.window_pivot(table(spark, sf_dir, "events"), "event_type", C.epoch(F.col("ts")), 300, names)
    cols = [F.col(f"`{n}`") for n in names]
    total = sum(cols, F.lit(0)).cast("decimal(38,0)")
    return wide.select("bin", total.alias("total"), F.greatest(*cols).alias("most"), sum((F.when(c > 0, 1).otherwise(0) for c in cols), F.lit(0)).cast("long").alias("kinds")).withColumn("total", F.col("total").cast("double"))


_SQL["alarm_window_pivot"] = _SQL["alarm_window_pivot"].replace("sum(n) AS total", "sum(n)::DOUBLE AS total")


@query("SELECT user_id AS node, epoch(ts) AS timestamp, event_type AS event, count(*) AS times FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def event_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.event_multiplicity(frame.event_seconds(table(spark, sf_dir, "events"), "ts"), "event_type", "timestamp", "user_id")


@query("SELECT event_id, user_id AS node FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)")
def events_on_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "node")
    return frame.on_topology(events, table(spark, sf_dir, "supplier").select("s_suppkey")).select("event_id", "node")


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS code FROM events")
def ordinal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.ordinal(table(spark, sf_dir, "events"), "event_type", "code").select("event_id", "code")


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS a, CASE WHEN event_id % 2 > 0 THEN user_id::DOUBLE END AS b FROM events)
SELECT event_id, round(coalesce(a, 0), 6) AS a, coalesce(b, 0) AS b FROM x WHERE a IS NOT NULL OR b IS NOT NULL""")
def drop_empty_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = e.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 2 > 0, F.col("user_id").cast("double")).alias("b"))
    return rounded(frame.drop_empty_fill(x, ["a", "b"]), 6)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 3")
def most_frequent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(3)


# --- event sequences ---------------------------------------------------------


@query("""WITH x AS (SELECT user_id AS node, epoch(ts) AS t, event_type AS event, count(*) AS times FROM events GROUP BY ALL)
SELECT b.node, b.t AS timestamp, b.event AS target, a.event AS cause, round(sum(a.times * exp(-0.0001 * (b.t - a.t))), 6) AS decay
FROM x a JOIN x b ON a.node = b.node AND a.t < b.t GROUP BY ALL""")
def hawkes_decay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.plans import hawkes

    e = frame.event_multiplicity(frame.event_seconds(table(spark, sf_dir, "events"), "ts"), "event_type", "timestamp", "user_id")
    alone = e.select("node").distinct().select("node", F.lit(0).alias("hop"), F.col("node").alias("neighbour"))
    out = hawkes.decay(e, alone, 0.0001)
    return rounded(out.select("node", "timestamp", F.col("event").alias("target"), "cause", "decay"), 6, "timestamp")


@query("""WITH x AS (SELECT user_id AS node, epoch(ts) AS t, event_type AS event, count(*) AS times FROM events GROUP BY ALL), e AS (SELECT max(t) AS last FROM x)
SELECT event AS cause, 0 AS hop, round(sum((1 - exp(-0.0001 * (last - t))) / 0.0001 * times), 2) AS mass FROM x, e GROUP BY event""")
def hawkes_decay_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causeway.plans import hawkes

    e = frame.event_multiplicity(frame.event_seconds(table(spark, sf_dir, "events"), "ts"), "event_type", "timestamp", "user_id")
    alone = e.select("node").distinct().select("node", F.lit(0).alias("hop"), F.col("node").alias("neighbour"))
    return rounded(hawkes.mass(e, alone, 0.0001), 2)


# --- graphs ------------------------------------------------------------------

#: Graphs over the nations, the same in both engines.
_DAG = "SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation WHERE n_nationkey < (n_nationkey * 3 + 1) % 25 UNION SELECT n_nationkey, (n_nationkey * 7 + 4) % 25 FROM nation WHERE n_nationkey < (n_nationkey * 7 + 4) % 25"
_EST = "SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation WHERE n_nationkey <> (n_nationkey * 3 + 1) % 25 UNION SELECT (n_nationkey * 2 + 5) % 25, n_nationkey FROM nation WHERE n_nationkey <> (n_nationkey * 2 + 5) % 25"
_CYCLIC = "SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst, (n_nationkey * 11 % 17 + 1)::DOUBLE AS weight FROM nation WHERE n_nationkey <> (n_nationkey * 3 + 1) % 25"


def _edges(spark: SparkSession, sf_dir: str, *rules: tuple[int, int, bool, bool]) -> DataFrame:
    n = F.col("n_nationkey")
    out = None
    for a, b, up, back in rules:
        to = (n * a + b) % 25
        e = table(spark, sf_dir, "nation").filter(n < to if up else n != to).select(*((to.alias("src"), n.alias("dst")) if back else (n.alias("src"), to.alias("dst"))))
        out = e if out is None else out.union(e)
    return out.distinct()


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, (3, 1, True, False), (7, 4, True, False))


def estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, (3, 1, False, False), (2, 5, False, True))


_REACH = "reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src)"


@query(f"WITH RECURSIVE e AS ({_DAG}), {_REACH} SELECT src, dst FROM reach")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(dag(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({_EST}), {_REACH} SELECT (SELECT count(*) FROM e) AS n_edges, count(*) FILTER (src = dst) AS on_cycles, count(*) FILTER (src = dst) = 0 AS is_dag FROM reach")
def acyclicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.is_dag(estimate(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({_DAG}), walk AS (SELECT n_nationkey AS node, 0 AS level FROM nation UNION SELECT e.dst, walk.level + 1 FROM walk JOIN e ON walk.node = e.src)
SELECT node, max(level)::INTEGER AS level FROM walk GROUP BY node""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(dag(spark, sf_dir), table(spark, sf_dir, "nation").select("n_nationkey"))


@query(f"""WITH RECURSIVE e AS ({_DAG}), walk AS (SELECT n_nationkey AS node, 0 AS level FROM nation UNION SELECT e.dst, walk.level + 1 FROM walk JOIN e ON walk.node = e.src),
top AS (SELECT node, max(level) AS level FROM walk GROUP BY node) SELECT node, (row_number() OVER (ORDER BY level, node) - 1)::INTEGER AS position FROM top""")
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_path_rank(dag(spark, sf_dir), table(spark, sf_dir, "nation").select("n_nationkey"))


@query(f"""WITH RECURSIVE d AS ({_DAG}), e AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d), walk AS (SELECT DISTINCT src AS node, 0 AS hop, src AS neighbour FROM e UNION SELECT walk.node, walk.hop + 1, e.dst FROM walk JOIN e ON walk.neighbour = e.src WHERE walk.hop < 3)
SELECT node, min(hop)::INTEGER AS hop, neighbour FROM walk GROUP BY node, neighbour""")
def k_hop_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop_ring(dag(spark, sf_dir), 3)


@query(f"WITH e AS ({_EST}) SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN count(*) = 2 THEN 'undirected' WHEN min(src) < min(dst) THEN 'forward' ELSE 'backward' END AS kind FROM e GROUP BY 1, 2")
def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.typed(estimate(spark, sf_dir))


@query(f"""WITH e AS ({_DAG}), near AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
SELECT a.src AS i, a.dst AS k, b.src AS j FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.src = a.src AND near.dst = b.src)""")
def unshielded_colliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dag(spark, sf_dir)
    near = e.union(graph.reverse(e)).distinct()
    pairs = e.select(F.col("src").alias("i"), F.col("dst").alias("k")).join(e.select(F.col("src").alias("j"), F.col("dst").alias("k")), "k").filter("i < j")
    return pairs.join(near.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_anti").select("i", "k", "j")


@query(f"""WITH e AS ({_DAG}), near AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT n_nationkey AS i, m::INTEGER AS j, [(n_nationkey + m) % 25, (n_nationkey * m) % 25] AS sep FROM nation, range(25) r(m) WHERE n_nationkey < m),
seps AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.src = s.i AND near.dst = s.j))
SELECT i, x.dst AS k, j FROM seps JOIN near x ON x.src = i JOIN near y ON y.src = j AND y.dst = x.dst WHERE NOT list_contains(sep, x.dst)""")
def separated_v_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dag(spark, sf_dir)
    near = e.union(graph.reverse(e)).distinct()
    n = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(24)))).filter(n < F.col("m")).select(n.alias("i"), F.col("m").alias("j"), F.array((n + F.col("m")) % 25, (n * F.col("m")) % 25).alias("sepset"))
    return graph.v_structures(e, s.join(near.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_anti"))


_DENSE = f"{_DAG} UNION SELECT n_nationkey, (n_nationkey * 2 + 3) % 25 FROM nation WHERE n_nationkey < (n_nationkey * 2 + 3) % 25 UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey < (n_nationkey + 1) % 25 UNION SELECT n_nationkey, (n_nationkey + 2) % 25 FROM nation WHERE n_nationkey < (n_nationkey + 2) % 25"
_MIXED = f"m AS (SELECT src, dst FROM ({_DENSE}) UNION SELECT dst, src FROM ({_DENSE}) WHERE (src * 5 + dst * 3) % 7 < 4), lines AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM m b WHERE b.src = m.dst AND b.dst = m.src)), arrows AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.src = m.dst AND b.dst = m.src)), near AS (SELECT src, dst FROM m UNION SELECT dst, src FROM m)"
_MEEK = {
    1: "SELECT DISTINCT g.src, g.dst FROM lines g JOIN arrows k ON k.dst = g.src WHERE k.src <> g.dst AND NOT EXISTS (SELECT 1 FROM near WHERE near.src = k.src AND near.dst = g.dst)",
    2: "SELECT DISTINCT g.src, g.dst FROM lines g JOIN arrows a ON a.src = g.src JOIN arrows b ON b.src = a.dst AND b.dst = g.dst",
    3: "SELECT DISTINCT g.src, g.dst FROM lines g JOIN lines k ON k.src = g.src JOIN arrows kj ON kj.src = k.dst AND kj.dst = g.dst JOIN lines l ON l.src = g.src JOIN arrows lj ON lj.src = l.dst AND lj.dst = g.dst WHERE k.dst < l.dst AND NOT EXISTS (SELECT 1 FROM near WHERE near.src = k.dst AND near.dst = l.dst)",
    4: "SELECT DISTINCT g.src, g.dst FROM lines g JOIN lines k ON k.src = g.src JOIN arrows kl ON kl.src = k.dst JOIN arrows lj ON lj.src = kl.dst AND lj.dst = g.dst WHERE k.dst <> g.dst AND NOT EXISTS (SELECT 1 FROM near WHERE near.src = k.dst AND near.dst = g.dst)",
}


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir, (3, 1, True, False), (7, 4, True, False), (2, 3, True, False), (1, 1, True, False), (1, 2, True, False))
    return e.union(graph.reverse(e).filter((F.col("dst") * 5 + F.col("src") * 3) % 7 < 4)).distinct()


def _add_meek(rule: int) -> None:
    def arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.meek_arrows(_mixed(spark, sf_dir), rule)

    arrows.__name__ = f"meek_rule_{rule}"
    query(f"WITH {_MIXED} {_MEEK[rule]}")(arrows)


for _rule in _MEEK:
    _add_meek(_rule)


def _class_sql(rounds: int = 6) -> str:
    """Edges of the class of _DAG: those of v-structures, those that follow from them in so many rounds, and the rest both ways."""
    near = lambda a, b: f"EXISTS (SELECT 1 FROM near WHERE a = {a} AND b = {b})"
    ctes = [f"d AS ({_DAG})", "near AS (SELECT src AS a, dst AS b FROM d UNION SELECT dst, src FROM d)", f"f0 AS (SELECT DISTINCT x.src, x.dst FROM d x JOIN d y ON x.dst = y.dst AND x.src <> y.src WHERE NOT {near('x.src', 'y.src')})"]
    for k in range(rounds):
        away = f"EXISTS (SELECT 1 FROM f{k} z WHERE z.dst = x.src AND NOT {near('z.src', 'x.dst')})"
        through = f"EXISTS (SELECT 1 FROM f{k} z JOIN f{k} w ON z.dst = w.src WHERE z.src = x.src AND w.dst = x.dst)"
        beside = f"EXISTS (SELECT 1 FROM f{k} z JOIN f{k} w ON z.dst = w.dst AND z.src <> w.src WHERE z.dst = x.dst AND {near('x.src', 'z.src')} AND {near('x.src', 'w.src')} AND NOT {near('z.src', 'w.src')})"
        ctes.append(f"f{k + 1} AS (SELECT src, dst FROM f{k} UNION SELECT src, dst FROM d x WHERE {away} OR {through} OR {beside})")
    last = f"f{rounds}"
    return f"WITH {', '.join(ctes)} SELECT src, dst FROM {last} UNION SELECT a, b FROM near WHERE NOT EXISTS (SELECT 1 FROM {last} WHERE (src = a AND dst = b) OR (src = b AND dst = a))"


@query(_class_sql())
def equivalence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cpdag(dag(spark, sf_dir))


@query(f"WITH e AS ({_DAG}) SELECT src, sum((1::BIGINT << (24 - dst::BIGINT)))::BIGINT AS number FROM e GROUP BY src")
def graph_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_number(dag(spark, sf_dir), 25)


@query("SELECT n_nationkey, list_reduce(list_transform([n_nationkey % 2, n_regionkey % 2, (n_nationkey // 3) % 2, 1], lambda x: x::BIGINT), lambda a, x: a * 2 + x)::BIGINT AS number FROM nation")
def matrix_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    bits = F.array(n % 2, F.col("n_regionkey") % 2, F.floor(n / 3).cast("int") % 2, F.lit(1))
    number = C.bits_to_number(bits)
    back = C.bits_to_number(C.number_to_bits(number, 4))  # there and back again
    return table(spark, sf_dir, "nation").select("n_nationkey", back.alias("number"))


@query("SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON (a.n_nationkey * 7) % 25 < (b.n_nationkey * 7) % 25 OR ((a.n_nationkey * 7) % 25 = (b.n_nationkey * 7) % 25 AND a.n_nationkey < b.n_nationkey)")
def order_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    order = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct(((n * 7) % 25).alias("p"), n.alias("node")))).alias("o")).select(F.col("o.node").alias("order"))
    return graph.order_to_graph("order", order)


@query(f"WITH e AS ({_DAG}) SELECT round(count(*) FILTER ((src * 7) % 25 < (dst * 7) % 25) / count(*), 6) AS cover_rate FROM e")
def order_cover_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.cover_rate(dag(spark, sf_dir), order_to_graph(spark, sf_dir)), 6)


@query(f"""WITH RECURSIVE e AS ({_CYCLIC}), cuts AS (SELECT 0::DOUBLE AS w UNION SELECT DISTINCT weight FROM e), reach AS (SELECT w, src, dst FROM cuts JOIN e ON weight > w UNION SELECT reach.w, reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src AND e.weight > reach.w),
best AS (SELECT min(w) AS w FROM cuts WHERE w NOT IN (SELECT w FROM reach WHERE src = dst)) SELECT src, dst, weight FROM e, best WHERE weight > best.w""")
def threshold_to_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(n.alias("src"), ((n * 3 + 1) % 25).alias("dst"), (n * 11 % 17 + 1).cast("double").alias("weight")).filter("src <> dst")
    return graph.threshold_to_dag(e)


@query(f"WITH e AS ({_CYCLIC}) SELECT src, dst, weight FROM e WHERE abs(weight) > 9")
def prune_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(n.alias("src"), ((n * 3 + 1) % 25).alias("dst"), (n * 11 % 17 + 1).cast("double").alias("weight")).filter("src <> dst")
    return graph.prune(e, 9)


_KINDS = "k_{0} AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN count(DISTINCT src) = 2 THEN 'u' WHEN min(src) < min(dst) THEN 'f' ELSE 'b' END AS k FROM {0} GROUP BY 1, 2)"
_COMPARED = f"e AS ({_EST}), t AS ({_DAG}), {_KINDS.format('e')}, {_KINDS.format('t')}, c AS (SELECT coalesce(k_e.a, k_t.a) AS a, coalesce(k_e.b, k_t.b) AS b, k_e.k AS est, k_t.k AS tru FROM k_e FULL JOIN k_t ON k_e.a = k_t.a AND k_e.b = k_t.b)"


@query(f"""WITH {_COMPARED}, n AS (SELECT count(*) FILTER (est IS NOT NULL AND tru IS NOT NULL AND (est = 'u' OR est = tru)) AS tp, count(*) FILTER (est IS NOT NULL AND tru IS NULL) AS fp, count(*) FILTER (est <> 'u' AND tru IS NOT NULL AND est <> tru) AS turned,
count(*) FILTER (est IS NULL) AS missing, count(*) FILTER (est IS NOT NULL) AS nnz, count(*) FILTER (tru IS NOT NULL) AS cond, sum(CASE WHEN est = 'u' THEN 2 WHEN est IS NOT NULL THEN 1 ELSE 0 END) AS pe FROM c)
SELECT round((turned + fp) / greatest(nnz, 1), 4) AS fdr, round(tp / greatest(cond, 1), 4) AS tpr, round((turned + fp) / greatest(25 * 24 / 2 - cond, 1), 4) AS fpr, round(tp / pe, 4) AS precision, round(tp / cond, 4) AS recall,
round(2 * (tp / pe) * (tp / cond) / (tp / pe + tp / cond), 4) AS f1, round(greatest(0, tp - (pe - tp)) / cond, 4) AS gscore, (fp + missing + turned)::BIGINT AS shd, nnz FROM n""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.graph_metrics(estimate(spark, sf_dir), dag(spark, sf_dir), 25)


@query(f"WITH {_COMPARED} SELECT CASE WHEN tru IS NULL THEN 'extra' WHEN est IS NULL THEN 'missing' WHEN est = tru OR est = 'u' THEN 'right' ELSE 'reversed' END AS part, a, b FROM c")
def graph_edge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_parts(estimate(spark, sf_dir), dag(spark, sf_dir))


@query(f"WITH e AS ({_EST}), k AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT src, dst FROM e WHERE src NOT IN (FROM k) AND dst NOT IN (FROM k)")
def edges_without_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_nodes(estimate(spark, sf_dir), table(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey"))


@query(f"WITH e AS ({_EST}) SELECT src, dst FROM (SELECT src, dst FROM e UNION SELECT 3 AS src, 9 AS dst UNION SELECT 4, 9) WHERE NOT (src = 0 AND dst = 1) AND NOT (src = 9 AND dst = 5)")
def prior_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priors.apply_priors(estimate(spark, sf_dir), priors.prior_table(spark, [(3, 9), (4, 9)], [(0, 1), (9, 5)]))


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation)
SELECT a.k AS src, b.k AS dst, CASE WHEN a.k = b.k THEN 0 WHEN (a.k, b.k) IN ((3, 9), (4, 9)) THEN 1 WHEN (a.k, b.k) IN ((8, 1), (9, 5)) THEN 0 ELSE -1 END AS status FROM n a, n b""")
def prior_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select("n_nationkey")
    return priors.full_matrix(priors.prior_table(spark, [(3, 9), (4, 9)], [(8, 1), (9, 5)]), nodes)


# --- sources and sinks -------------------------------------------------------


@query(f"WITH e AS ({_DAG}), n AS (SELECT n_nationkey AS k FROM nation), pairs AS (SELECT src::VARCHAR AS a, dst::VARCHAR AS b FROM e UNION ALL SELECT k::VARCHAR, '-' FROM n WHERE k NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) SELECT a AS source, b AS target FROM pairs")
def edge_list_with_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.edge_list(dag(spark, sf_dir), table(spark, sf_dir, "nation").select("n_nationkey"))


@query(f"WITH e AS ({_DAG}), m AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, EXISTS (SELECT 1 FROM e WHERE src = a.n_nationkey AND dst = b.n_nationkey)::INTEGER AS v FROM nation a, nation b) SELECT string_agg(v::VARCHAR, ' ' ORDER BY i, j) AS row FROM m")
def submission_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.submission_row(dag(spark, sf_dir), 25)


@query("SELECT n_nationkey, [n_nationkey, n_regionkey]::INTEGER[] AS snapshot FROM nation")
def tuple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.tuple_of_ints(text).alias("snapshot"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    t = table(spark, sf_dir, "nation")
    path = f"{graph.shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    files.write_table(t.select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_table(spark, path, schema="n_nationkey int, n_name string, n_regionkey int")
