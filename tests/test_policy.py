"""Derivatives, networks and searches of the policy learners."""

import numpy as np
import pytest

from causeway.functions import autodiff as ad
from causeway.operators.moments import moments
from causeway.operators.scores import FamilyFit, graph_reward, reward_bounds
from causeway.plans import base, policy, score  # noqa: F401


def check(f, x, steps=12, seed=0):
    """f(Value) -> scalar Value against central differences at some places."""
    v = ad.Value(x)
    (g,) = ad.gradient(f(v), [v])
    rng = np.random.default_rng(seed)
    for at in rng.choice(x.size, min(steps, x.size), replace=False):
        up, down = x.copy().ravel(), x.copy().ravel()
        up[at] += 1e-6
        down[at] -= 1e-6
        want = (float(f(ad.Value(up.reshape(x.shape))).x) - float(f(ad.Value(down.reshape(x.shape))).x)) / 2e-6
        assert abs(want - g.ravel()[at]) < 1e-4 * max(1, abs(want))


def test_rules_against_differences():
    rng = np.random.default_rng(1)
    x, w, y = rng.normal(size=(3, 4)), rng.normal(size=(4, 5)), rng.normal(size=(2, 3, 4))
    for f in (
        lambda v: (ad.tanh(v @ w) * ad.sigmoid(v @ w)).sum(),
        lambda v: (ad.log_softmax(v) * x).sum() + ad.softmax(v)[1, 2] * 3,
        lambda v: ((v - v.mean(-1, keepdims=True)) ** 2 / (1 + ad.exp(v))).mean(),
        lambda v: (v.reshape(1, 3, 4) * y / (2.0 - ad.tanh(v))).sum(axis=(0, 2)).sum(),
        lambda v: (ad.joined([v, v * 2.0], axis=1).swap() @ np.ones((3, 2))).sum() + ad.root(v * v).sum(),
        lambda v: ad.inverse(v @ w[:, :3] + 3 * np.eye(3))[0, 1] + ad.log(ad.softplus(v)).sum() + ad.leaky(v).sum() + ad.relu(v).sum() + ad.absolute(v).sum(),
        lambda v: (y @ v.swap()).sum() + (5.0 / (v**2 + 1.0))[[0, 0, 2]].sum(),
    ):
        check(f, x)


@pytest.mark.parametrize("encoder", ["transformer", "gat", "none"])
@pytest.mark.parametrize("decoder", ["single", "bilinear", "ntn"])
def test_graph_networks_against_differences(encoder, decoder):
    rng = np.random.default_rng(2)
    actor = policy.RL(encoder=encoder, decoder=decoder, hidden=8, heads=2, blocks=1, decoder_hidden=3, samples=5)
    p = actor.network(4)
    tokens, weight = rng.normal(size=(2, 4, 5)), rng.normal(size=(2, 4, 4))

    def f(flat):
        v = {}
        at = 0
        for name, shape in p.shapes.items():
            n = int(np.prod(shape))
            v[name] = flat[at : at + n].reshape(*shape)
            at += n
        o = actor.options()
        e = policy.encode(v, tokens, o["blocks"], o["heads"], o["encoder"])
        return (policy.edge_logits(v, e, decoder, "tanh") * weight).sum() + policy.judged(v, tokens.mean(axis=1)[:, :1] * np.ones(8)).sum()

    check(f, p.start(rng), steps=40)


def simulated(spark, d, n, chance, seed):
    rng = np.random.default_rng(seed)
    place, w = rng.permutation(d), np.zeros((d, d))
    for a in range(d):
        for b in range(a + 1, d):
            if rng.random() < chance:
                w[place[a], place[b]] = rng.uniform(0.5, 1.5) * rng.choice([-1, 1])
    x = rng.gumbel(size=(n, d)) @ np.linalg.inv(np.eye(d) - w)
    return spark.createDataFrame(x.tolist(), [f"x{i}" for i in range(d)]), (w != 0).astype(int)


def distance(a, b):
    return int((np.abs(a - b) + np.abs(a - b).T > 0)[np.triu_indices(len(a), 1)].sum())


def test_family_fit_agrees_with_graph_rewards(spark):
    df, truth = simulated(spark, 5, 300, 0.5, 4)
    m = moments(df, df.columns)
    for equal in (True, False):
        fit = FamilyFit(df, df.columns, "LR", equal)
        assert fit.graph(truth) == pytest.approx(graph_reward(m, truth, equal), abs=1e-6)
        assert fit.bounds() == pytest.approx(reward_bounds(m, equal), abs=1e-6)
        left, edges = fit.parts(np.stack([truth]))
        total = np.log(left.sum()) + edges.sum() if equal else np.log(left).sum() + edges.sum()
        assert total == pytest.approx(fit.graph(truth), abs=1e-6)


def test_curves_explain_what_lines_do_not(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=400), rng.normal(size=400)
    rows = np.column_stack([a, b, np.sin(2 * a) + 0.1 * rng.normal(size=400), a * b + 0.1 * rng.normal(size=400)])
    df = spark.createDataFrame(rows.tolist(), ["a", "b", "curve", "product"])
    left = {r: FamilyFit(df, df.columns, r, alpha=0.1) for r in ("LR", "QR", "GPR")}
    spread = {k: f.m.cov[2, 2] for k, f in left.items()}
    assert left["GPR"].residual(2, [0]) < 0.1 * spread["GPR"] < left["LR"].residual(2, [0]) * spread["GPR"] / spread["LR"]
    assert left["QR"].residual(3, [0, 1]) < 0.05 * left["LR"].residual(3, [0, 1])


def test_edges_on_cycles():
    g = np.zeros((1, 5, 5))
    for i, j in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4)):
        g[0, i, j] = 1
    assert np.argwhere(policy.on_cycles(g)[0]).tolist() == [[0, 1], [1, 2], [2, 0]]


def test_attention_finds_twelve_nodes_better_than_tables(spark):
    df, truth = simulated(spark, 12, 2000, 0.3, 5)
    df = df.persist()
    fit = FamilyFit(df, df.columns)
    tables = base.make("graphsearch", equal_variances=True, rounds=150).learn(df, df.columns)
    found = base.make("rl", tasks=4, steps=12, rounds=20).learn(df, df.columns)
    assert found.notes["course"][-1] < found.notes["course"][0]
    assert distance(found.matrix, truth) < distance(tables.matrix, truth) and fit.graph(found.matrix) < fit.graph(tables.matrix)


@pytest.mark.parametrize(("reward", "decoder", "encoder", "regression"), [("episodic", "lstm", "transformer", "LR"), ("dense", "mlp", "mlp", "QR")])
def test_pointer_finds_an_ordering(spark, reward, decoder, encoder, regression):
    df, truth = simulated(spark, 6, 1000, 0.5, 7)
    g = base.make("corl", reward=reward, decoder=decoder, encoder=encoder, regression=regression, rounds=6, steps=6, tasks=4).learn(df, df.columns)
    assert sorted(g.notes["order"]) == list(range(6)) and distance(g.matrix, truth) <= (0 if regression == "LR" else 3)
    again = base.make("corl", reward=reward, decoder=decoder, encoder=encoder, regression=regression, rounds=6, steps=6, tasks=4).learn(df.repartition(7), df.columns)
    assert again.notes["order"] == g.notes["order"] and np.array_equal(again.matrix, g.matrix)
