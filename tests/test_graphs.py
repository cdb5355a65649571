"""Graph operators, metrics and priors on small graphs."""

from itertools import combinations

import numpy as np
import pytest

from causeway.operators import graph, metrics, priors
from causeway.plans import dense


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src int, dst int")


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


METRICS = [
    (2, [(0, 1)], [(0, 1), (1, 0)], {"tpr": 1.0, "nnz": 1}),
    (4, [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], {"tpr": 1.0}),
    (4, [(0, 1)], [(2, 3), (3, 2)], {"tpr": 0.0, "fpr": 0.2, "nnz": 1}),
    (4, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], {"tpr": 1, "fdr": 0, "fpr": 0, "shd": 0, "nnz": 5, "f1": 1, "gscore": 1}),
    (3, [(0, 1), (0, 2), (1, 2)], [(1, 0), (0, 2), (1, 2)], {"shd": 1, "nnz": 3, "precision": 0.6667, "recall": 0.6667}),
]


@pytest.mark.parametrize("d,true,est,want", METRICS)
def test_metrics(spark, d, true, est, want):
    row = metrics.graph_metrics(edges(spark, est), edges(spark, true), d).first()
    for k, v in want.items():
        assert row[k] == pytest.approx(v), k


def test_metrics_of_an_empty_estimate(spark):
    row = metrics.graph_metrics(edges(spark, []), edges(spark, [(0, 1)]), 3).first()
    assert (row["shd"], row["tpr"], row["nnz"], row["precision"]) == (1, 0, 0, None)


def test_traversals(spark):
    diamond = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node int")
    assert pairs(graph.closure(diamond)) == {(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)}
    assert graph.is_dag(diamond).first()["is_dag"]
    assert not graph.is_dag(edges(spark, [(0, 1), (1, 2), (2, 0)])).first()["is_dag"]
    assert {r["node"]: r["level"] for r in graph.levels(diamond, nodes).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 0}
    rings = {(r["node"], r["hop"], r["neighbour"]) for r in graph.k_hop_ring(edges(spark, [(0, 1), (1, 2), (2, 3)]), 2).collect()}
    assert {x for x in rings if x[0] == 0} == {(0, 0, 0), (0, 1, 1), (0, 2, 2)}


def test_cpdag_of_known_graphs(spark):
    both = lambda *e: {(a, b) for x in e for a, b in (x, x[::-1])}
    cases = {
        ((0, 1), (1, 2)): both((0, 1), (1, 2)),
        ((0, 2), (1, 2)): {(0, 2), (1, 2)},
        ((1, 0), (1, 2)): both((0, 1), (1, 2)),
        ((0, 1), (0, 2), (1, 2)): both((0, 1), (0, 2), (1, 2)),
        ((0, 1), (0, 2), (1, 3), (2, 3)): both((0, 1), (0, 2)) | {(1, 3), (2, 3)},
    }
    for dag, want in cases.items():
        assert pairs(graph.cpdag(edges(spark, dag))) == want
        a = np.zeros((4, 4), dtype=int)
        a[tuple(zip(*dag))] = 1
        assert {tuple(map(int, e)) for e in np.argwhere(dense.class_of_dag(a))} == want


MEEK = {
    1: ([(0, 1), (1, 2), (2, 1)], {(1, 2)}),
    2: ([(0, 1), (1, 2), (0, 2), (2, 0)], {(0, 2)}),
    3: ([(0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (3, 0), (1, 3), (2, 3)], {(0, 3)}),
    4: ([(0, 1), (1, 0), (1, 2), (2, 3), (0, 3), (3, 0), (0, 2), (2, 0)], {(0, 3)}),
}


@pytest.mark.parametrize("rule", MEEK)
def test_meek_rules(spark, rule):
    e, want = MEEK[rule]
    assert pairs(graph.meek_arrows(edges(spark, e), rule)) == want


def test_class_of_random_dags_is_stable():
    rng = np.random.default_rng(0)
    for _ in range(60):
        d = int(rng.integers(3, 7))
        p = rng.permutation(d)
        dag = np.tril((rng.random((d, d)) < 0.5).astype(int), -1)[np.ix_(p, p)]
        c = dense.class_of_dag(dag)
        back = dense.extend_to_dag(c)
        assert ((back | back.T) == (dag | dag.T)).all() and (dense.class_of_dag(back) == c).all() and dense.is_acyclic(back)


def test_orientation_from_separating_sets(spark):
    skeleton = edges(spark, [(0, 2), (2, 0), (1, 2), (2, 1), (2, 3), (3, 2)])
    seps = spark.createDataFrame([(0, 1, []), (0, 3, [2]), (1, 3, [2])], "i int, j int, sepset array<int>")
    assert {(r["i"], r["k"], r["j"]) for r in graph.v_structures(skeleton, seps).collect()} == {(0, 2, 1)}
    assert pairs(graph.meek(graph.orient_v_structures(skeleton, seps))) == {(0, 2), (1, 2), (2, 3)}


def test_threshold_to_dag(spark):
    rng = np.random.default_rng(3)
    w = np.round(rng.normal(size=(6, 6)), 3)
    df = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in np.argwhere(w) if i != j], "src int, dst int, weight double")
    cut = dense.cut_to_dag(w)
    assert pairs(graph.threshold_to_dag(df)) == {tuple(map(int, e)) for e in np.argwhere(cut)}
    assert dense.is_acyclic(cut)


def test_orders(spark):
    order = spark.createDataFrame([([2, 0, 1],)], "o array<int>")
    full = graph.order_to_graph("o", order)
    assert pairs(full) == {(2, 0), (2, 1), (0, 1)}
    assert graph.cover_rate(edges(spark, [(2, 1), (1, 0)]), full).first()["cover_rate"] == 0.5


def test_priors(spark):
    p = priors.prior_table(spark, [(3, 9)], [(0, 1), (1, 0), (9, 5)], [(6, 7)])
    assert pairs(priors.apply_priors(edges(spark, [(0, 1), (9, 5), (2, 4)]), p)) == {(3, 9), (6, 7), (7, 6), (2, 4)}
    assert {(r["a"], r["b"]) for r in priors.forbidden_pairs(p).collect()} == {(0, 1)}
    assert priors.remove(p, edges(spark, [(0, 1)])).count() == p.count() - 1


def test_assignment_is_least(spark):
    from itertools import permutations

    rng = np.random.default_rng(5)
    for n in (1, 3, 5, 6):
        cost = rng.normal(size=(n, n))
        got = dense.assign(cost)
        assert sorted(got) == list(range(n))
        assert cost[np.arange(n), got].sum() == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_solver_respects_bounds():
    target = np.array([1.0, -2.0, 3.0])
    x = dense.minimise(lambda x: (float(((x - target) ** 2).sum()), 2 * (x - target)), np.ones(3), 0.0)
    assert np.allclose(x, [1, 0, 3], atol=1e-5)
    rosen = lambda x: (float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(dense.minimise(rosen, np.array([-1.2, 1.0]), steps=2000), [1, 1], atol=1e-3)


def test_gradients_of_acyclicity():
    w = np.random.default_rng(1).normal(size=(4, 4)) * 0.5
    for f in (dense.acyclicity, dense.acyclicity_power):
        h, grad = f(w)
        for i, j in combinations(range(4), 2):
            step = np.zeros((4, 4))
            step[i, j] = 1e-6
            assert (f(w + step)[0] - f(w - step)[0]) / 2e-6 == pytest.approx(grad[i, j], rel=1e-4, abs=1e-7)
