"""Networks, tasks, series."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.plans import base, neural  # noqa: F401
from causeway.sources import files, series, simulate, tasks


@pytest.mark.parametrize("name", ["notearsnetwork", "graphautoencoder"])
def test_networks_find_the_skeleton(spark, name):
    w = np.zeros((3, 3))
    w[0, 1] = 1.8
    df = simulate.sample(spark, w, 1200, seed=6, partitions=2).cache()
    g = base.make(name, max_iter=5, rounds=8).learn(df, ["x0", "x1", "x2"])
    s = (g.matrix | g.matrix.T).astype(bool)
    assert s[0, 1] and not s[0, 2] and not s[1, 2], g.weights


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(20, 3))
    net = neural.NotearsNetwork(hidden=2, lambda1=0.0)
    x = net.start(3, rng)

    def loss(x):
        a, b, c, c0 = net._split(x, 3)
        a = a * (1 - np.eye(3))[:, :, None]
        s = 1 / (1 + np.exp(-(np.einsum("ni,ijm->njm", data, a) + b)))
        return 0.5 * ((np.einsum("njm,jm->nj", s, c) + c0 - data) ** 2).sum() / len(data) + 0.5e-3 * (c * c).sum()

    g = net.gradient(3)(x, data, 0.0, 0.0)
    for k in rng.choice(len(x), 12, replace=False):
        e = np.zeros_like(x)
        e[k] = 1e-5
        assert (loss(x + e) - loss(x - e)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-6)
    auto = neural.GraphAutoencoder(hidden=2, lambda1=0.0)
    x = auto.start(3, rng)

    def auto_loss(x):
        a, enc, dec = auto._split(x, 3)
        net = lambda p, v: np.tanh(v[:, :, None] * p[:2] + p[2:4]) @ p[4:6] + p[6]
        return 0.5 * ((net(dec, net(enc, data) @ (a * (1 - np.eye(3)))) - data) ** 2).sum() / len(data)

    g = auto.gradient(3)(x, data, 0.0, 0.0)
    for k in range(len(x)):
        e = np.zeros_like(x)
        e[k] = 1e-5
        assert (auto_loss(x + e) - auto_loss(x - e)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-6)


def test_tasks_and_their_log(spark, tmp_path):
    log = str(tmp_path / "runs")
    graph, found = tasks.learn_task(spark, {"dataset": "iid_test", "dataset_options": {"n": 300}, "algorithm": "pc", "parameters": {"alpha": 0.01}, "metrics": ["shd", "f1"]}, log)
    assert len(graph.columns) == 10 and set(found) == {"shd", "f1"}
    with pytest.raises(ValueError):
        tasks.learn_task(spark, {"dataset": "iid_test", "algorithm": "nothing"}, log)
    rows = tasks.runs(spark, log).collect()
    assert sorted(r["status"] for r in rows) == ["done", "failed"] and json.loads(rows[-1]["metrics"]) == found
    config = tmp_path / "c.yaml"
    config.write_text(f"task: simulate\nkind: erdos_renyi\nnodes: 4\nedges: 4\nrows: 30\noutput: {tmp_path}/x.parquet\n")
    assert tasks.run_file(spark, str(config)).count() == 30 and files.read_table(spark, f"{tmp_path}/x.parquet").count() == 30


def test_series(spark):
    one, two = (series.causal_series(spark, 6, 64, partitions=p).orderBy("series_id").collect() for p in (1, 3))
    assert one == two and all(len(r.target) == 64 for r in one)
    df = spark.createDataFrame([([[1.0, 2.0], [5.0, 5.0]],), ([[3.0, 6.0], [5.0, 5.0]],)], "x array<array<double>>")
    out = np.array([r.x for r in series.normalise_series(df, "x").collect()])
    assert np.allclose(out[:, 0].mean(), 0) and np.allclose(out[:, 0].std(), 1) and np.allclose(out[:, 1], 0)


def test_grids_and_vectors(spark):
    assert simulate.pendulum(spark).count() == 84 * 87
    assert simulate.second_order_sample(spark, np.array([[0, 1.0], [0, 0]]), 10).count() == 10
    assert simulate.flow(spark).agg(F.min("reach")).first()[0] >= 0
    w = np.array([[0, 1.0], [0, 0]])
    for kind in (1, 2, 3):
        rows = simulate.vector_sample(spark, w, 20, 3, kind).collect()
        assert len(rows) == 20 and all(len(r.x1) == 3 for r in rows)
