"""Operators that were quadratic or one job a test, against plain versions; learners by likelihood."""

import numpy as np
import pandas as pd
import pytest

from causeway.operators import graph, independence, metrics, scores
from causeway.plans import base, constraint, continuous, deep, hawkes, tape  # noqa: F401
from causeway.plans.lingam import DirectLiNGAM
from causeway.sources import simulate, tasks


@pytest.mark.parametrize("delta", [0.01, 3.0, 200.0])
def test_decay_is_the_sum_over_pairs(spark, delta):
    rng = np.random.default_rng(3)
    log = pd.DataFrame({"node": rng.choice([0, 0, 0, 1, 2], 150), "timestamp": np.round(rng.uniform(0, 50, 150) ** 1.2, 1), "event": rng.choice(["a", "b"], 150)})
    events = log.groupby(["node", "timestamp", "event"]).size().rename("times").reset_index()
    rings = pd.DataFrame([(0, 0, 0), (1, 0, 1), (2, 0, 2), (0, 1, 1), (1, 1, 0), (1, 1, 2), (2, 1, 1)], columns=["node", "hop", "neighbour"])
    got = {(r.node, r.timestamp, r.event, r.hop, r.cause): r.decay for r in hawkes.decay(spark.createDataFrame(events), spark.createDataFrame(rings), delta).collect()}
    pairs = events.merge(rings, on="node").merge(events.rename(columns={"node": "neighbour", "timestamp": "then", "event": "cause", "times": "k"}), on="neighbour")
    pairs = pairs[pairs.then < pairs.timestamp]
    pairs["decay"] = pairs.k * np.exp(-delta * (pairs.timestamp - pairs.then))
    want = pairs.groupby(["node", "timestamp", "event", "hop", "cause"]).decay.sum().to_dict()
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-300)


def test_decay_of_nothing_and_of_one_time(spark):
    schema = "node long, timestamp double, event string, times long"
    rings = spark.createDataFrame([(1, 0, 1)], "node long, hop int, neighbour long")
    assert hawkes.decay(spark.createDataFrame([], schema), rings, 0.1).count() == 0
    assert hawkes.decay(spark.createDataFrame([(1, 5.0, "a", 2), (1, 5.0, "b", 1)], schema), rings, 0.1).count() == 0


def test_tables_of_the_decay_are_read_once(spark):
    """What several steps read is held, with the same results; TTPM gives it up again."""
    rng = np.random.default_rng(4)
    log = pd.DataFrame({"node": rng.choice([0, 0, 1], 80), "timestamp": np.round(rng.uniform(0, 90, 80), 1), "event": rng.choice(["a", "b"], 80)})
    events = spark.createDataFrame(log.groupby(["node", "timestamp", "event"]).size().rename("times").reset_index())
    rings = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "node long, hop int, neighbour long")
    held = []
    together, apart = (sorted(map(tuple, hawkes.decay(events, rings, 3.0, h).collect())) for h in (held, None))
    assert len(held) == 3 and all(df.is_cached for df in held)
    assert [r[:-1] for r in together] == [r[:-1] for r in apart]
    assert [r[-1] for r in together] == pytest.approx([r[-1] for r in apart], rel=1e-12)
    for df in held:
        df.unpersist()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    base.make("ttpm", delta=0.5, max_iter=2).learn(spark.createDataFrame(log))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_gap_medians_and_small_tables(spark):
    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(size=140), 1), rng.normal(size=140)  # x has ties
    blocks, n, k = independence._blocks(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", 40)
    gaps = [((v[:, None] - v[None, :]) ** 2)[np.triu_indices(140, 1)] for v in (x, y)]
    assert n == 140 and independence._gap_medians(independence._block_pairs(blocks, k)) == pytest.approx([np.median(g[g > 0]) for g in gaps], rel=1e-12)
    for blocks_n in (1, 2, 5, 6):
        b = spark.createDataFrame([(i, [0.0], [0.0]) for i in range(blocks_n)], "b int, xs array<double>, ys array<double>")
        met = [tuple(sorted((r.b_1, r.b_2))) for r in independence._block_pairs(b, blocks_n).collect()]
        assert sorted(met) == [(i, j) for i in range(blocks_n) for j in range(i, blocks_n)]
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert independence.hsic_test(few, "x", "y")["independent"] == 1
    same = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "x double, y double")
    assert independence.hsic_test(same, "x", "y", block=8)["independent"] in (0, 1)


def test_many_discrete_tests_are_the_single_ones(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, 600)
    df = pd.DataFrame({"a": a, "b": (a + rng.integers(0, 2, 600)) % 4, "c": rng.choice([-0.0, 0.0, 1.5], 600), "d": rng.choice(["x", None, "y"], 600)})
    rows = spark.createDataFrame(df, "a long, b long, c double, d string")
    asked = [("a", "b", []), ("a", "c", ["d"]), ("b", "c", ["a", "d"]), ("a", "a", ["b"])]
    for (statistic, dof, p), (x, y, z) in zip(independence.discrete_tests(rows, asked, "chi2"), asked, strict=True):
        one = independence.discrete_test(rows, x, y, z, "chi2")
        assert (statistic, dof, p) == (pytest.approx(one[0], rel=1e-12), one[1], pytest.approx(one[2], rel=1e-9))
    assert independence.discrete_tests(rows.limit(0), asked[:2]) == [(0.0, 0, 1.0)] * 2


@pytest.mark.parametrize("variant", ["stable", "parallel"])
def test_skeleton_in_rounds_is_the_one_by_one(variant):
    for seed in range(6):
        p = {}
        rng = np.random.default_rng(seed)

        def one(i, j, given, p=p, rng=rng):
            return p.setdefault((min(i, j), max(i, j), tuple(sorted(given))), float(rng.uniform() ** 3))

        g, separated = constraint.find_skeleton(7, one, 0.4, variant)
        h, too = constraint.find_skeleton(7, one, 0.4, variant, p_values=lambda tests: [one(*t) for t in tests])
        assert (g == h).all() and separated == too


def _differences(f, g, x, picks):
    for k in picks:
        e = np.zeros_like(x)
        e[k] = 1e-5
        assert (f(x + e) - f(x - e)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-6), k


def test_gradients_of_post_nonlinear_pairs():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(20, 3))
    pnl, pairs = deep.PNL(hidden=2), [(0, 1), (1, 0), (2, 1)]
    x = pnl.start(3, rng)
    _differences(lambda x: pnl.value(x, data, pairs), pnl.gradient(pairs)(x, data, 0.0, 0.0), x, range(len(x)))


@pytest.mark.parametrize("name", ["grandag", "daggnn"])
def test_likelihood_learners_find_the_skeleton(spark, name):
    w = np.zeros((3, 3))
    w[0, 1] = 1.8
    df = simulate.sample(spark, w, 1200, seed=6, partitions=2).cache()
    g = base.make(name, max_iter=4, rounds=6, threshold=0.2).learn(df, ["x0", "x1", "x2"])
    s = (g.matrix | g.matrix.T).astype(bool)
    assert s[0, 1] and not s[0, 2] and not s[1, 2], g.weights


def test_post_nonlinear_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": (x + 0.4 * rng.uniform(-1, 1, 500)) ** 3, "z": rng.normal(size=500)})).coalesce(2)
    g = deep.PNL().learn(df, ["x", "y", "z"])
    assert g.matrix[0, 1] == 1 and not g.matrix[2].any() and not g.matrix[:, 2].any()


def test_kernel_order(spark):
    w = np.zeros((3, 3))
    w[2, 0], w[0, 1] = 1.5, 1.2
    df = simulate.sample(spark, w, 2000, sem="exp", seed=1).cache()
    g = DirectLiNGAM(measure="kernel").learn(df, ["x0", "x1", "x2"])
    assert g.notes["order"] == [2, 0, 1] and g.matrix.tolist() == [[0, 1, 0], [0, 0, 0], [1, 0, 0]]
    with pytest.raises(ValueError):
        DirectLiNGAM(measure="other")


def test_masked_regression_opens_masks(spark):
    w = np.zeros((3, 3))
    w[0, 1], w[0, 2] = 1.5, -1.2
    g = base.make("maskedregression").learn(simulate.sample(spark, w, 2000, seed=2), ["x0", "x1", "x2"])
    s = g.matrix | g.matrix.T
    assert s[0, 1] and s[0, 2]


def test_small_operators(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src int, dst int")
    assert [tuple(r) for r in graph.without_nodes(edges, spark.createDataFrame([(1,), (1,)], "n int")).collect()] == [(2, 3)]
    truth = spark.createDataFrame([(0, 1), (2, 1)], "src int, dst int")
    lines = spark.createDataFrame([(1, 2)], "src int, dst int")
    both = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src int, dst int")
    assert metrics.graph_metrics(both.limit(1), truth, 4, lines).first() == metrics.graph_metrics(both, truth, 4).first()
    values = {"1": 1, "0.5": 0.5, "(1, 2)": (1, 2), "true": True, "None": None, "2*3": 6, "pc": "pc", "a*b": "a*b", "[1, 'x']": [1, "x"]}
    assert {k: tasks.coerce(k) for k in values} == values and tasks.coerce(3) == 3
    rng = np.random.default_rng(1)
    x, y, z = rng.normal(size=(3, 800))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "t": x * y + 0.1 * rng.normal(size=800)}))
    cols = ["x", "y", "z", "t"]
    full = np.zeros((4, 4), dtype=int)
    full[:3, 3] = 1
    assert scores.prune_second_order(scores.family_moments(df, cols, 2), cols, full)[:, 3].tolist() == [1, 1, 0, 0]
    assert "ttpm" in base.LEARNERS and isinstance(base.make("ttpm", delta=0.2), hawkes.TTPM)
