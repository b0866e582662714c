"""Trees over many rows: how many passes they take, and the same trees by every path."""

import numpy as np
import pytest

from test_trees import table
from veridra.operators import trees as T

SETS = {"two": ["a", "b"], "one": ["c"], "all": ["c", "a", "b"]}


def boosted(df):
    models = T.fit_boosted(df, SETS, "y", T.Trees(6, 4, boosting=True, rate=0.3, l2=0.7, least=5))
    return {s: {r.id: r.predicted for r in m.predict(df, ["id"]).collect()} for s, m in models.items()}


def test_boosting_of_many_rows_takes_no_pass_per_level(spark, monkeypatch):
    _, df = table(spark)
    monkeypatch.setattr(T, "ROWS", 40)
    monkeypatch.setattr(T, "ALONE", 0)
    monkeypatch.setattr(T, "REFRESH", 2)
    passes = boosted(df)
    monkeypatch.setattr(T, "ALONE", 2_000_000)
    monkeypatch.setattr(T, "_boost", None)
    for cells in (1, 20, 1 << 15):
        monkeypatch.setattr(T, "CELLS", cells)
        alone = boosted(df)
        for s, own in passes.items():
            assert all(np.isclose(alone[s][k], v, atol=1e-8) for k, v in own.items())


@pytest.mark.parametrize("small", [0, 32 << 20])
def test_a_forest_over_few_distinct_rows_takes_one_pass(spark, monkeypatch, small):
    data, df = table(spark)
    cfg = T.Trees(7, 5, boosting=False, least=2, seed=3)
    monkeypatch.setattr(T, "ROWS", 40)
    monkeypatch.setattr(T, "SMALL", small)
    with monkeypatch.context() as m:
        m.setattr(T, "CELLS", 0)
        passes = T.fit_trees(df, ["a", "b", "c"], "y", ["id"], cfg)
    monkeypatch.setattr(T, "_forest", None)
    one = T.fit_trees(df, ["a", "b", "c"], "y", ["id"], cfg)
    assert (one.grown.feature == passes.grown.feature).all() and (one.grown.cut == passes.grown.cut).all()
    assert np.allclose(one.grown.value, passes.grown.value)


def test_predictions_equal_a_walk_down_every_tree(spark, monkeypatch):
    data, df = table(spark)
    model = T.fit_trees(df, ["a", "b", "c"], "y", ["id"], T.Trees(5, 6, boosting=False, least=2, seed=3))
    bins = np.array([[np.searchsorted(c, v) if v is not None else 0 for c, v in zip(model.cuts, r[1:4])] for r in data])
    want = model.mean + sum(model.grown.value[t][model.grown.node(t, bins, 6)] for t in range(5)) / 5
    for known in (0, 1 << 18):
        monkeypatch.setattr(T, "KNOWN", known)
        got = {r.id: r.predicted for r in model.predict(df, ["id"]).collect()}
        assert np.allclose([got[r[0]] for r in data], want)
