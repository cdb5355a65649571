"""Learners recover the graphs that simulated data come from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.plans import base, constraint, continuous, hawkes, lingam, pairwise, score  # noqa: F401
from causeway.plans.dense import class_of_dag
from causeway.sources import files, simulate

COLUMNS = ["x0", "x1", "x2", "x3", "x4"]


@pytest.fixture(scope="module")
def truth():
    w = np.zeros((5, 5))
    w[0, 1], w[0, 2], w[1, 3], w[2, 3], w[3, 4] = 1.4, -0.8, 1.0, 1.3, -1.2
    return w


@pytest.fixture(scope="module")
def gauss(spark, truth):
    return simulate.sample(spark, truth, 3000, seed=4).cache()


@pytest.fixture(scope="module")
def skewed(spark, truth):
    return simulate.sample(spark, truth, 4000, sem="exp", seed=5).cache()


def shd(a, b):
    a, b = np.asarray(a) != 0, np.asarray(b) != 0
    return sum((a[i, j], a[j, i]) != (b[i, j], b[j, i]) for i in range(len(a)) for j in range(i))


@pytest.mark.parametrize("variant", ["original", "stable", "parallel"])
def test_pc(gauss, truth, variant):
    g = base.make("pc", variant=variant, alpha=0.001).learn(gauss, COLUMNS)
    assert shd(g.matrix, class_of_dag(truth != 0)) == 0


def test_pc_with_priors_and_own_test(gauss, truth):
    g = base.make("pc", alpha=0.001, required=[("x0", "x1")], forbidden=[("x1", "x0"), ("x0", "x4"), ("x4", "x0")]).learn(gauss, COLUMNS)
    assert g.matrix[0, 1] == 1 and g.matrix[1, 0] == 0
    never = base.make("pc", test=lambda df, x, y, z: 1.0).learn(gauss, COLUMNS)
    assert not never.matrix.any()
    with pytest.raises(ValueError):
        base.make("pc", nonsense=1)


@pytest.mark.parametrize("method", ["scatter", "r2"])
def test_ges(gauss, truth, method):
    assert shd(base.make("ges", method=method).learn(gauss, COLUMNS).matrix, class_of_dag(truth != 0)) == 0


def test_ges_and_pc_on_discrete_columns(spark):
    u = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0
    df = spark.range(3000).withColumn("a", (u(1) < 0.5).cast("int")).withColumn("b", (u(2) < 0.5).cast("int"))
    df = df.withColumn("c", F.when(u(3) < 0.9, F.col("a").bitwiseXOR(F.col("b")).bitwiseOR(F.col("a"))).otherwise((u(4) < 0.5).cast("int"))).cache()
    for g in (score.GES("bdeu").learn(df, ["a", "b", "c"]), constraint.PC(test="g2", alpha=0.001).learn(df, ["a", "b", "c"])):
        assert g.matrix.tolist() == [[0, 0, 1], [0, 0, 1], [0, 0, 0]]


@pytest.mark.parametrize("name,options", [("directlingam", {}), ("icalingam", {"max_iter": 60})])
def test_lingam(skewed, truth, name, options):
    g = base.make(name, **options).learn(skewed, COLUMNS)
    assert shd(g.matrix, truth) == 0
    assert np.allclose(g.weights[truth != 0], truth[truth != 0], atol=0.15)


def test_bootstrap(spark, skewed):
    found = lingam.bootstrap(skewed, ["x0", "x1", "x3"], ["row"], 2, lingam.DirectLiNGAM()).cache()
    assert {(r["src"], r["dst"]) for r in lingam.direction_counts(found).filter("n = 2").collect()} >= {(0, 1)}
    assert lingam.graph_counts(found).agg(F.sum("n")).first()[0] == 2
    assert lingam.edge_probabilities(found, 2).agg(F.max("probability")).first()[0] == 1.0
    effect = {(r["src"], r["dst"]): r["effect"] for r in lingam.median_effects(found, 2).collect()}
    assert effect[0, 1] == pytest.approx(1.4, abs=0.15)


@pytest.mark.parametrize("name,options,most", [("notears", {"max_iter": 30}, 1), ("golem", {"steps": 3000}, 1), ("notearslowrank", {"rank": 3}, 4), ("ordersearch", {"equal_variances": True, "rounds": 80}, 1), ("graphsearch", {"equal_variances": True}, 2), ("maskedregression", {"max_iter": 12}, 5)])
def test_continuous(gauss, truth, name, options, most):
    g = base.make(name, **options).learn(gauss, COLUMNS)
    assert shd(g.matrix, truth) <= most, (name, g.matrix)


def test_notears_other_losses(spark):
    w = np.zeros((3, 3))
    w[0, 1], w[1, 2] = 2.0, -2.0
    df = simulate.sample(spark, w, 1500, sem="logistic", seed=2).cache()
    g = base.make("notears", loss="logistic", lambda1=0.01, max_iter=4, steps=15, rho_max=1e4).learn(df, ["x0", "x1", "x2"])
    assert (g.matrix | g.matrix.T)[0, 1] and (g.matrix | g.matrix.T)[1, 2]


def test_notears_basis(spark):
    w = np.zeros((3, 3))
    w[0, 1] = w[1, 2] = 1
    df = simulate.sample(spark, w, 2000, method="nonlinear", sem="gp-add", seed=3).cache()
    g = base.make("notearsbasis", max_iter=8, rho_max=1e8, threshold=0.1).learn(df, ["x0", "x1", "x2"])
    assert dense_ok(g.matrix)


def dense_ok(a):
    from causeway.plans.dense import is_acyclic

    return is_acyclic(a) and a.any()


def test_anm_direction(spark):
    df = spark.range(250).select((2 * (F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(10000)) / 10000.0) - 1).alias("x"), simulate.noise("uniform", 0.15, 1, F.col("id")).alias("z"))
    df = df.withColumn("y", F.col("x") + 2 * F.pow("x", 3) + F.col("z")).cache()
    anm = base.make("anm", alpha=0.01)
    assert anm.direction_holds(df, "x", "y") and not anm.direction_holds(df, "y", "x")


def test_simulated_tables_do_not_depend_on_partitions(spark, truth):
    one, many = (simulate.sample(spark, truth, 500, seed=1, partitions=p).orderBy("row").collect() for p in (1, 7))
    assert one == many
    for method, sem in (("linear", "gumbel"), ("linear", "uniform"), ("nonlinear", "mlp"), ("nonlinear", "mim"), ("nonlinear", "gp"), ("quadratic", "gauss")):
        rows = simulate.sample(spark, truth, 50, method, sem, seed=1).toPandas()
        assert rows.shape == (50, 6) and np.isfinite(rows.to_numpy()).all()
    with pytest.raises(ValueError):
        simulate.sample(spark, np.ones((2, 2)), 5)


@pytest.mark.parametrize("kind", ["erdos_renyi", "scale_free", "bipartite", "hierarchical", "low_rank"])
def test_random_dags(kind):
    from causeway.plans.dense import is_acyclic

    w = simulate.random_dag(kind, 20, 40, seed=3)
    assert is_acyclic(w != 0) and 10 < (w != 0).sum() < 80 and np.abs(w[w != 0]).min() >= 0.5
    assert (w == simulate.random_dag(kind, 20, 40, seed=3)).all()


def test_ttpm_recovers_cascades(spark):
    alpha = np.zeros((3, 3))
    alpha[0, 1] = 0.8
    topology = simulate.random_topology(6, 6, 1)
    log = simulate.cascade(spark, alpha, np.full(3, 0.02), topology, 400.0, max_hop=0, beta=2.0, seed=2).cache()
    assert log.columns == ["event", "timestamp", "node"]
    g = hawkes.TTPM(delta=2.0, max_iter=8).learn(log)
    assert g.columns == ["e00", "e01", "e02"] and (g.matrix - np.eye(3, dtype=int)).tolist() == [[0, 1, 0], [0, 0, 0], [0, 0, 0]]
    forced = hawkes.TTPM(delta=2.0, max_iter=2, required=[("e02", "e00")], forbidden=[("e00", "e01")]).learn(log, simulate.edges_of(spark, topology).select("src", "dst"))
    assert forced.matrix[2, 0] == 1 and forced.matrix[0, 1] == 0


def test_files(spark, tmp_path):
    w = np.array([[0, 1.5, 0], [0, 0, 0], [0, 0, 0]])
    np.save(tmp_path / "DAG.npy", w)
    assert [tuple(r) for r in files.read_matrix(spark, str(tmp_path / "DAG.npy")).collect()] == [(0, 1, 1.5)]
    log = spark.createDataFrame([("a", 1.0, 0, 9), ("b", 2.0, 1, 9)], "event string, timestamp double, node int, duration int")
    files.write_table(log, str(tmp_path / "Alarm.csv"))
    assert files.read_events(spark, str(tmp_path / "Alarm.csv")).count() == 2
    data, truth, topology = files.datasets.load(spark, "alarm_archive", folder=str(tmp_path))
    assert data.count() == 2 and truth.count() == 1 and topology is None
    with pytest.raises(ValueError):
        files.write_table(log, str(tmp_path / "x.xls"))
    with pytest.raises(ValueError):
        files.datasets.load(spark, "nothing")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    assert files.edge_list_json(files.read_matrix(spark, str(tmp_path / "DAG.npy")), nodes) == '[["0", "1"], ["2", "-"]]'
    data, truth, _ = files.datasets.load(spark, "iid_test", n=50)
    assert data.count() == 50 and truth.count() > 5


def test_stream_counts_match_the_bounded_ones(spark, tmp_path):
    from causeway.streaming import windows

    rows = spark.range(400).select((F.timestamp_seconds(F.col("id") * 40)).alias("ts"), F.concat(F.lit("e"), F.col("id") % 3).alias("event"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), "ts timestamp, event string, v double", 1)
    q = windows.window_counts(stream, "event", "ts").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event"]): r["n"] for r in spark.table("counts").collect()}
    want = {(r["start"], r["event"]): r["n"] for r in windows.window_counts(rows, "event", "ts").collect()}
    assert got == want and sum(got.values()) == 400
    sums = windows.window_sums(rows, ["v"], "ts", "1 hour").agg(F.sum("n"), F.sum("s_v"), F.sum("p_v_v")).first()
    assert tuple(sums) == (400, sum(range(400)), sum(i * i for i in range(400)))
