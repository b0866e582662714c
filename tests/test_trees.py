"""Grown trees against plain Python growers, node by node."""

import hashlib

import numpy as np
import pytest

from veridra.operators import trees as T
from veridra.operators.draws import draws
from veridra.sources.workspace import stored


def table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 6, n).astype(float), np.round(rng.normal(0, 3, n)), rng.integers(0, 3, n).astype(float)
    y = 3 * a - np.abs(b) + (c == 1) * 5 + rng.normal(0, 0.5, n)
    data = [(i, float(a[i]), None if i % 19 == 0 else float(b[i]), float(c[i]), float(y[i])) for i in range(n)]
    return data, stored(spark.createDataFrame(data, "id long, a double, b double, c double, y double").repartition(3))


def grow(x, w, g, depth, l2, least, node=0, level=0, out=None):
    """{node: (feature, value up to which rows go left, None at leaves; leaf value)} by trying every cut of every node."""
    out = {} if out is None else out
    total_w, total_g = w.sum(), g.sum()
    value = total_g / (total_w + l2)
    best = None
    if level < depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1] if (w > 0).any() else []:
                left = x[:, f] <= cut
                lw, lg, rw, rg = w[left].sum(), g[left].sum(), w[~left].sum(), g[~left].sum()
                if lw < max(least, 1) or rw < max(least, 1):
                    continue
                gain = lg * lg / (lw + l2) + rg * rg / (rw + l2) - total_g**2 / (total_w + l2)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    if best is None or best[0] <= 1e-9:
        out[node] = (None, None, value)
        return out
    _, f, cut = best
    left = x[:, f] <= cut
    out[node] = (f, cut, value)
    grow(x[left], w[left], g[left], depth, l2, least, 2 * node + 1, level + 1, out)
    grow(x[~left], w[~left], g[~left], depth, l2, least, 2 * node + 2, level + 1, out)
    return out


def walk(tree, row):
    node = 0
    while tree[node][0] is not None:
        node = 2 * node + 1 + (row[tree[node][0]] > tree[node][1])
    return tree[node][2]


def columns(data):
    return np.array([[r[1], -1e9 if r[2] is None else r[2], r[3]] for r in data]), np.array([r[4] for r in data])


@pytest.mark.parametrize("rows", [40, 50_000])
def test_boosting_equals_a_plain_grower(spark, monkeypatch, rows):
    data, df = table(spark)
    x, y = columns(data)
    monkeypatch.setattr(T, "REFRESH", 3)
    monkeypatch.setattr(T, "ROWS", rows)
    cfg = T.Trees(8, 3, boosting=True, rate=0.3, l2=0.7, least=5)
    got = {r.id: r.predicted for r in T.fit_trees(df, ["a", "b", "c"], "y", ["id"], cfg).predict(df, ["id"]).collect()}
    f = np.full(len(y), y.mean())
    for _ in range(cfg.trees):
        tree = grow(x, np.ones(len(y)), y - f, cfg.depth, cfg.l2, cfg.least)
        f = f + cfg.rate * np.array([walk(tree, r) for r in x])
    assert np.allclose([got[r[0]] for r in data], f, atol=1e-8)


@pytest.mark.parametrize(("rows", "small"), [(10, 32 << 20), (40, 0), (50_000, 32 << 20)])
def test_boosting_over_sets_equals_a_plain_grower_each(spark, monkeypatch, rows, small):
    data, df = table(spark)
    x, y = columns(data)
    for name, value in (("REFRESH", 2), ("ROWS", rows), ("SMALL", small)):
        monkeypatch.setattr(T, name, value)
    cfg = T.Trees(5, 3, boosting=True, rate=0.3, l2=0.7, least=5)
    sets = {"two": [0, 1], "one": [2], "all": [2, 0, 1], "none": []}
    models = T.fit_boosted(df, {s: ["abc"[i] for i in at] for s, at in sets.items()}, "y", cfg)
    for s, at in sets.items():
        f = np.full(len(y), y.mean())
        for _ in range(cfg.trees if at else 0):
            tree = grow(x[:, at], np.ones(len(y)), y - f, cfg.depth, cfg.l2, cfg.least)
            f = f + cfg.rate * np.array([walk(tree, r) for r in x[:, at]])
        got = {r.id: r.predicted for r in models[s].predict(df, ["id"]).collect()}
        assert np.allclose([got[r[0]] for r in data], f, atol=1e-8), s


@pytest.mark.parametrize("small", [0, 32 << 20])
def test_a_forest_equals_a_plain_grower_node_by_node(spark, monkeypatch, small):
    data, df = table(spark)
    x, y = columns(data)
    monkeypatch.setattr(T, "SMALL", small)
    monkeypatch.setattr(T, "ROWS", 40)
    monkeypatch.setattr(T, "ROOM", 60_000)
    cfg = T.Trees(5, 4, boosting=False, least=2, seed=3)
    model = T.fit_trees(df, ["a", "b", "c"], "y", ["id"], cfg)
    keys = [hashlib.md5(str(r[0]).encode()).hexdigest() for r in data]
    w = draws(3, np.arange(5), np.array([int(k[:8], 16) for k in keys]), np.array([int(k[8:16], 16) for k in keys]))
    plain = [grow(x, w[t], w[t] * (y - y.mean()), cfg.depth, 0.0, cfg.least) for t in range(5)]
    for t, tree in enumerate(plain):
        for node, (f, cut, value) in tree.items():
            assert model.grown.feature[t, node] == (-1 if f is None else f)
            assert np.isclose(model.grown.value[t, node], value)
    got = {r.id: r.predicted for r in model.predict(df, ["id"]).collect()}
    # rows that no tree drew may fall between two cuts of equal gain; all others must agree
    drawn = w.sum(axis=0) > 0
    want = np.array([y.mean() + np.mean([walk(t, r) for t in plain]) for r in x])
    assert np.allclose(np.array([got[r[0]] for r in data])[drawn], want[drawn]) or np.mean(np.isclose([got[r[0]] for r in data], want)) > 0.95


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(7)
    v = rng.exponential(2, 3000)
    df = stored(spark.createDataFrame([(float(x), float(i % 4)) for i, x in enumerate(v)], "v double, k double"))
    cuts = T.bin_cuts(df, ["v", "k"], 16)
    assert np.allclose(cuts[0], np.quantile(v, np.arange(1, 16) / 16)) and cuts[1].tolist() == [0.0, 1.0, 2.0]


def test_text_features_and_edges(spark):
    data = [(i, ["x", "y", None][i % 3], f"w{i % 50}", [1.0, 5.0, 9.0][i % 3], "train" if i % 5 else "test") for i in range(200)]
    rows = stored(spark.createDataFrame(data, "id long, t string, u string, y double, part string"))
    train = rows.filter("part = 'train'")
    ready, names = T.tree_columns(train, rows, ["t", "u"])
    assert len(names) == 4  # three categories, and a place for the column of fifty
    cfg = T.Trees(3, 2, boosting=True, rate=1.0)
    model = T.fit_trees(ready.filter("part = 'train'"), names, "y", ["id"], cfg)
    for r in model.predict(ready, ["id", "y"]).collect():
        assert abs(r.predicted - r.y) < 1e-6
    none = T.fit_trees(train.limit(0).selectExpr("id", "y", "y AS z"), ["z"], "y", ["id"], cfg)
    assert [r.predicted for r in none.predict(rows.selectExpr("id", "y AS z").limit(1), ["id"]).collect()] == [0.0]
    same = stored(spark.createDataFrame([(i, 1.0, 4.0) for i in range(30)] + [(99, 1.0, None)], "id long, z double, y double"))
    for c in (cfg, T.Trees(2, 3, boosting=False)):
        assert {round(r.predicted, 9) for r in T.fit_trees(same, ["z"], "y", ["id"], c).predict(same, ["id"]).collect()} == {4.0}
