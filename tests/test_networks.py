"""Networks differentiated by rule, preselection, additive models, and what does not depend on partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import tails
from causeway.operators.scores import BIC, BDeu
from causeway.plans import base, cam, continuous, deep, dense, lingam, neural, score, tape
from causeway.sources import simulate

NETS = [
    lambda: tape.GraNDAG(hidden=3, lambda1=0.3),
    lambda: tape.GraNDAG(hidden=3, layers=2, normalise=True, activation="sigmoid"),
    lambda: tape.MCSL(hidden=3, layers=2, activation="tanh"),
    lambda: tape.MCSL(model="qr"),
    lambda: tape.NotearsMLP(hidden=3, layers=2),
    lambda: tape.DAGGNN(hidden=3),
    lambda: tape.DAGGNN(form="sem", lambda1=0.0),
]


@pytest.mark.parametrize("net", NETS)
def test_gradients_are_those_of_the_losses(net):
    net, rng = net(), np.random.default_rng(0)
    data, d = rng.normal(size=(15, 3)), 3
    x = net.start(d, rng) + 0.05 * rng.normal(size=net.parameters(d).size)
    p = net.parameters(d)

    def loss(x):
        return float(net.loss(p.values(x), data, 2.0, 0.7, np.random.default_rng(5)).x)

    g = net.gradient(d)(x, data, 2.0, 0.7, np.random.default_rng(5))
    for k in rng.choice(len(x), min(25, len(x)), replace=False):
        e = np.zeros_like(x)
        e[k] = 1e-5
        assert (loss(x + e) - loss(x - e)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-5)


def test_masked_inputs_are_not_seen():
    net = tape.GraNDAG(hidden=3, mask=np.array([[0, 1, 0], [0, 0, 1], [0, 0, 0]]))
    w = net.weights(net.start(3, np.random.default_rng(1)), 3)
    assert w[0, 1] > 0 and w[1, 2] > 0 and (w > 0).sum() == 2
    for make in (tape.MCSL, tape.NotearsMLP, tape.DAGGNN):
        x = make(mask=net.mask)
        assert not (np.abs(x.weights(x.start(3, np.random.default_rng(1)) + 0.1, 3)) > 0)[np.array(net.mask) == 0].any()
    with pytest.raises(ValueError):
        tape.GraNDAG(activation="step")


@pytest.fixture(scope="module")
def chain(spark):
    """x0 -> x1 -> x2 by curves, x3 alone."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=1200)
    b = np.tanh(2 * a) + 0.3 * rng.normal(size=1200)
    c = b**2 + 0.3 * rng.normal(size=1200)
    return spark.createDataFrame(np.column_stack([a, b, c, rng.normal(size=1200)]).tolist(), ["x0", "x1", "x2", "x3"]).persist()


def test_preselection_keeps_true_parents(chain):
    m = tape.preselected(chain, ["x0", "x1", "x2", "x3"], 2)
    assert m[0, 1] and m[1, 2] and not m[3, :3].any() and m.sum(axis=0).max() <= 2
    g = tape.GraNDAG(max_iter=3, rounds=3, neighbours=2, holdout=0.2, cutoff=0.001, threshold=0.05).learn(chain, ["x0", "x1", "x2", "x3"])
    s = g.matrix | g.matrix.T
    assert s[0, 1] and s[1, 2] and not s[3].any() and not (g.matrix * (1 - g.notes["preselection"])).any()


@pytest.mark.parametrize(("name", "options"), [("mcsl", {"rounds": 6}), ("mcsl", {"model": "qr", "rounds": 6}), ("notearsmlp", {"threshold": 0.2})])
def test_networks_find_the_skeleton(chain, name, options):
    g = base.make(name, max_iter=5, **options).learn(chain, ["x0", "x1", "x3"])
    s = g.matrix | g.matrix.T
    assert s[0, 1] and not s[2].any(), g.weights


@pytest.mark.parametrize(("name", "options"), [("grandag", {"threshold": 0.1}), ("daggnn", {"threshold": 0.1}), ("daggnn", {"form": "sem", "threshold": 0.1}), ("notearsnetwork", {"threshold": 0.2})])
def test_networks_do_not_depend_on_partitions(chain, name, options):
    columns = ["x0", "x1", "x3"]
    one, two = (base.make(name, max_iter=3, rounds=3, **options).learn(chain.repartition(n), columns) for n in (3, 8))
    assert np.array_equal(one.matrix, two.matrix) and np.allclose(one.weights, two.weights, atol=1e-6)


@pytest.mark.parametrize("net", [*NETS, lambda: neural.NotearsNetwork(hidden=3), lambda: neural.GraphAutoencoder(hidden=3), lambda: tape.VectorAutoencoder(hidden=3), lambda: deep.PNL(hidden=3)])
def test_shards_together_are_those_one_by_one(net):
    """Shards of unlike lengths, one under a batch and one over the rows that are shuffled at a time."""
    net, rng = net(), np.random.default_rng(4)
    pairs = [(0, 1), (1, 0), (2, 1)]
    gradient, x = net.gradient(pairs if isinstance(net, deep.PNL) else 3), net.start(3, rng)
    shards = [(k, rng.normal(size=(n, 3))) for k, n in ((0, 300), (2, 9), (5, 331))]
    shards += [(7, rng.normal(size=(neural.SHARD + 20, 3)))] if isinstance(net, neural.NotearsNetwork) else []
    together = neural._steps(shards, gradient, x, 2.0, 0.7, 0.02, 32, 1)
    for shard, p in zip(shards, together, strict=True):
        assert np.allclose(neural._steps([shard], gradient, x, 2.0, 0.7, 0.02, 32, 1)[0], p, atol=1e-7)


def test_tasks_of_training_are_bounded(chain, monkeypatch):
    columns = ["x0", "x1", "x3"]
    rows = neural.dealt(chain, columns, 10)
    assert rows.rdd.getNumPartitions() == neural.TASKS and rows.select("_shard").distinct().count() > 100
    held = [[r._shard for r in part] for part in rows.rdd.glom().collect()]
    assert all(part == sorted(part) for part in held) and max(map(len, held)) < 2 * 1200 / neural.TASKS
    assert sum(len(set(part)) for part in held) == len(set(sum(held, [])))  # a shard is in one task
    net = neural.NotearsNetwork(hidden=3)

    def trained() -> np.ndarray:
        rows = neural.dealt(chain, columns, 10).drop("_u")
        return neural.average_training(rows, net.gradient(3), net.start(3, np.random.default_rng(0)), 1.0, 0.0, 2, 0.02, 8, 0)

    first = trained()
    monkeypatch.setattr(neural, "TASKS", 3)
    monkeypatch.setattr(neural, "SHARDS_A_TASK", 50)
    assert np.allclose(trained(), first, atol=1e-9)
    assert neural.dealt(chain.limit(0), columns).count() == 0 and neural.dealt(chain, columns).rdd.getNumPartitions() == 1


def test_rounds_read_packed_rows(chain, monkeypatch):
    """A record a shard, not one a row; shards of several records and unlike lengths give the same parameters."""
    columns = ["x0", "x1", "x3"]
    rows, net = neural.dealt(chain, columns, 100).drop("_u"), neural.NotearsNetwork(hidden=3)
    shards = rows.select("_shard").distinct().count()
    assert neural.packed(rows).count() == shards > 5
    start = net.start(3, np.random.default_rng(0))
    plain = neural.average_training(rows, net.gradient(3), start, 1.0, 0.0, 2, 0.02, 8, 0)
    assert np.array_equal(neural.average_training(neural.packed(rows), net.gradient(3), start, 1.0, 0.0, 2, 0.02, 8, 0), plain)
    monkeypatch.setattr(neural, "SHARD", 20)
    held = rows.toPandas()
    batches = neural.packed(rows).toArrow().to_batches()
    found = {k: np.array(v) for k, v in neural._unpacked(iter(batches))}
    assert all(np.array_equal(found[k], part[columns].to_numpy()) for k, part in held.groupby("_shard")) and len(found) == shards < sum(map(len, batches))


def test_rows_are_made_once(spark, chain):
    """What the rows are derived by runs once, not again for means and deviations."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    neural.GraphAutoencoder(max_iter=1, rounds=2).learn(chain.mapInArrow(count, chain.schema), ["x0", "x1"])
    assert made.value == 1200


def test_batches_of_even_and_uneven_shards():
    shards = [np.arange(2.0 * n).reshape(n, 2) for n in (320, 331, 9, 300)]
    rows, sizes = neural._batches(shards, 32, [np.random.default_rng(k) for k in range(4)])
    assert sizes.sum(axis=1).tolist() == [320, 331, 9, 300] and sizes.max() - sizes[[0, 1, 3]][sizes[[0, 1, 3]] > 0].min() <= 2
    for k, data in enumerate(shards):
        there = np.arange(rows.shape[2]) < sizes[k][:, None]
        assert np.array_equal(rows[k][there], data[np.random.default_rng(k).permutation(len(data))]) and not rows[k][~there].any()


def test_codes_of_several_numbers():
    """The mix along the edges is one product a shard."""
    rng, net = np.random.default_rng(1), tape.VectorAutoencoder(hidden=3, code=2)
    net.length = 2
    data, x = rng.normal(size=(12, 6)), net.start(3, rng)
    p = net.parameters(3).values(x)
    a, code = p["graph"].x * net.off(3), tape.shared(p, "code", data.reshape(36, 2)).x.reshape(12, 3, 2)
    out = tape.shared(p, "back", np.einsum("ij,nic->njc", a, code).reshape(36, 2)).x.reshape(12, 6)
    assert float(net.loss(p, data, 0.0, 0.0, rng).x) == pytest.approx(0.5 * ((out - data) ** 2).sum() / 12, rel=1e-12)
    g, loss = net.gradient(3)(x, data, 2.0, 0.7, rng), lambda x: float(net.loss(net.parameters(3).values(x), data, 2.0, 0.7, rng).x)
    for k in rng.choice(len(x), 25, replace=False):
        e = np.eye(len(x))[k] * 1e-5
        assert (loss(x + e) - loss(x - e)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-5)


def test_derivatives_that_nobody_asks_for():
    """Those by constants, as the data and the rows' shares, are not worked out."""
    from causeway.functions.autodiff import Value, gradient

    def never(g):
        raise AssertionError

    x = Value([1.0, 2.0])
    constant = Value([3.0, 4.0], [(Value([3.0, 4.0]), never)])
    assert np.array_equal(gradient((x * constant).sum(), [x])[0], [3.0, 4.0])


@pytest.mark.parametrize("units", ["tanh", "sigmoid", "relu", "leaky_relu"])
def test_layers_in_place(units):
    from causeway.functions import layers

    v = np.concatenate([np.random.default_rng(1).normal(size=200) * 3, [0.0, 800.0, -800.0]])
    want = {"tanh": np.tanh, "sigmoid": lambda x: 0.5 * (1 + np.tanh(x / 2)), "relu": lambda x: np.maximum(x, 0), "leaky_relu": lambda x: np.where(x > 0, x, 0.25 * x)}[units]
    act, slope = layers.UNITS[units]
    y = act(v.copy())
    assert np.allclose(y, want(v), rtol=0, atol=1e-15 * max(1, np.abs(want(v)).max()))
    inner = np.abs(v) > 1e-3
    assert np.allclose(slope(y)[inner], (want(v + 1e-6) - want(v - 1e-6))[inner] / 2e-6, atol=1e-6)


def test_vectors_of_numbers(spark):
    w = np.zeros((3, 3))
    w[0, 1] = 1.5
    df = simulate.vector_sample(spark, w, 1000, 3, 1)
    names = [c for c in df.columns if c.startswith("x")]
    g = tape.VectorAutoencoder(max_iter=4, rounds=5).learn(df, names)
    s = g.matrix | g.matrix.T
    assert g.matrix.shape == (3, 3) and s[0, 1] and not s[2].any(), g.weights
    with pytest.raises(ValueError):
        tape.VectorAutoencoder().learn(df.withColumn("y", F.lit(1.0)), [*names, "y"])
    with pytest.raises(ValueError):
        tape.VectorAutoencoder().learn(df.withColumn("y", F.array(F.lit(1.0))), [*names, "y"])


def test_splines_and_tails():
    x = np.linspace(-2, 3, 200)
    b = cam.spline_columns(x, np.array([-1.0, 0.0, 0.5, 2.0]))
    assert b.shape == (200, 6) and np.allclose(b.sum(axis=1), 1) and (b >= 0).all()
    assert tails.f_tail(4.0, 3, 20) == pytest.approx(0.02212, abs=1e-4)
    assert tails.f_tail(161.4476, 1, 1) == pytest.approx(0.05, abs=1e-5) and tails.f_tail(0, 2, 2) == 1


def test_additive_model(chain):
    columns = ["x0", "x1", "x2", "x3"]
    g = cam.CAM().learn(chain, columns)
    assert [tuple(e) for e in np.argwhere(g.matrix)] == [(0, 1), (1, 2)]
    assert np.array_equal(g.matrix, cam.CAM().learn(chain.repartition(7), columns).matrix)
    few = cam.CAM(neighbours=1, cutoff=1.0).learn(chain, columns)
    assert few.matrix.sum(axis=0).max() <= 1
    m = cam.SplineMoments(chain, columns)
    assert m.fit(1, [0])[0] < 0.15 * m.cov[1, 1] and m.p_value(1, [0, 3], 3) > 0.001 > m.p_value(1, [0, 3], 0)


def test_bootstrap_in_common_passes(spark, monkeypatch):
    w = np.zeros((4, 4))
    w[2, 0], w[0, 1], w[0, 3] = 1.5, 1.2, -0.8
    df = simulate.sample(spark, w, 1500, sem="exp", seed=1).withColumn("key", F.monotonically_increasing_id()).persist()
    columns = ["x0", "x1", "x2", "x3"]
    model, passes = lingam.DirectLiNGAM(), []
    counted = lingam.batch_totals
    monkeypatch.setattr(lingam, "batch_totals", lambda *a, **k: passes.append(1) or counted(*a, **k))
    together = model.learn_replicates(df, columns, ["key"], 6, 0, lingam.moments(df, columns))
    assert len(passes) == 1 + 3  # moments, and one for each variable but the last
    for one, two in zip(together, lingam._one_by_one(df, columns, ["key"], 6, model, 0, 2), strict=True):
        assert one.notes["order"] == two.notes["order"] and np.allclose(one.weights, two.weights, atol=1e-8)
    edges = lingam.bootstrap(df, columns, ["key"], 6, model)
    assert {(r.src, r.dst) for r in edges.collect()} == {(2, 0), (0, 1), (0, 3)}


def test_families_are_counted_together(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 3, 800), rng.integers(0, 2, 800)
    df = spark.createDataFrame(np.column_stack([a, b, (a + b >= 2) ^ (rng.random(800) < 0.1)]).tolist(), "a long, b long, c long")
    together, alone = BDeu(df, ["a", "b", "c"]), BDeu(df, ["a", "b", "c"])
    families = [(y, p) for y in range(3) for p in ([], [(y + 1) % 3], [(y + 2) % 3], [(y + 1) % 3, (y + 2) % 3])]
    together.prepare(families)
    assert together.jobs == 1
    assert [together.of(*f) for f in families] == pytest.approx([alone.of(*f) for f in families]) and together.jobs == 1 and alone.jobs == 12
    counted = BDeu(df, ["a", "b", "c"])
    g, gain = score.greedy_equivalence_search(3, counted)
    assert counted.jobs <= 6 and gain > 0 and g[0, 2] and g[1, 2] and not g[0, 1]
    assert score.greedy_equivalence_search(3, BIC(lingam.moments(df, ["a", "b", "c"])))[1] > 0


def test_counts_of_a_family(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y")], "a long, b string")
    counts = BDeu(df, ["a", "b"]).counts(1, [0])
    assert counts.dtypes == [("a", "bigint"), ("b", "string"), ("n_ijk", "bigint")]
    assert {tuple(r) for r in counts.collect()} == {(1, "x", 2), (1, None, 1), (2, "y", 1)}
    assert [tuple(r) for r in BDeu(df, ["a", "b"]).counts(0, []).orderBy("a").collect()] == [(1, 3), (2, 1)]


def test_line_search_in_one_pass(spark):
    rng = np.random.default_rng(8)
    x = (rng.random((600, 2)) < 0.5).astype(float)
    x[:, 1] = (rng.random(600) < 1 / (1 + np.exp(-(4 * x[:, 0] - 2)))).astype(float)
    df = spark.createDataFrame(x.tolist(), ["a", "b"]).persist()
    loss = continuous.row_loss(df, ["a", "b"], "logistic", 600)
    points = [np.array([[0, v], [0, 0]]) for v in (0.0, 0.5, 1.0)]
    for w, (value, grad) in zip(points, loss.many(points), strict=True):
        one = loss(w)
        assert value == pytest.approx(one[0]) and np.allclose(grad, one[1])
    calls = {"one": 0, "many": 0}

    def valley(v):
        x, y = v
        return float((1 - x) ** 2 + 100 * (y - x * x) ** 2), np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    def f(v):
        calls["one"] += 1
        return valley(v)

    plain = dense.minimise(f, np.array([-1.5, 2.0]))
    trials = calls["one"]
    f.many = lambda points: calls.__setitem__("many", calls["many"] + 1) or [valley(p) for p in points]
    calls["one"] = 0
    assert np.allclose(plain, 1, atol=1e-3) and np.allclose(dense.minimise(f, np.array([-1.5, 2.0])), 1, atol=1e-3) and calls["one"] + calls["many"] < 0.9 * trials


def test_published_alarm_sets_by_name(spark, tmp_path):
    from causeway.sources import files

    folder = tmp_path / "18V_55N_Wireless"
    folder.mkdir()
    (folder / "Alarm.csv").write_text("Alarm_Name,Start_Timestamp,Device\na,1,2\n")
    np.save(folder / "DAG.npy", np.eye(2, k=1))
    (tmp_path / "18V_55N_Wireless.tar.gz").write_bytes(b"other")
    events, truth, topology = files.datasets.load(spark, "V18_N55_Wireless", root=str(tmp_path))
    assert events.count() == 1 and [tuple(r) for r in truth.collect()] == [(0, 1)] and topology is None
    with pytest.raises(ValueError):
        files.datasets.load(spark, "V18_N55_Wireless", root=str(tmp_path), check=True)
    assert set(files.ALARM_SETS) <= set(files.datasets.names())


def test_planted_edges_are_found_in_the_tables(spark):
    """Columns with known causes, derived from customers and events as the queries derive them."""
    import os

    from causeway.plans import learn

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    edges = lambda f: {(r.src_name, r.dst_name) for r in f(spark, folder).collect()}
    assert edges(learn.learn_anm) == {("a", "e")}
    assert edges(learn.learn_pnl) == {("a", "p")}
    assert edges(learn.learn_ttpm_echo) == {("click", "echo"), ("click", "click"), ("view", "view"), ("echo", "echo")}
