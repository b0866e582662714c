"""Boosted trees over a grid of two blocks of columns, and predictions by looked-up bits."""

import numpy as np

from test_trees import table
from test_trees_large import SETS
from veridra.operators import trees as T


def test_a_grid_of_two_blocks_grows_the_same_trees_without_a_step_per_row(monkeypatch):
    rng = np.random.default_rng(4)
    bins = np.array([[a, b, c, d] for a in range(5) for b in range(4) for c in range(6) for d in range(3)], np.uint8)
    bins = bins[rng.random(len(bins)) < 0.9]
    n = rng.integers(1, 9, len(bins)).astype(float)
    y = n * (bins[:, 0] * 2.0 - np.abs(bins[:, 1] - 1.5) * bins[:, 2] + rng.normal(0, 1, len(bins)))
    cfg = T.Trees(9, 4, boosting=True, rate=0.3, l2=0.7, least=20)
    monkeypatch.setattr(T, "CELLS", 20)
    blocks, sizes = T._blocks(bins), [5, 4, 6, 3]
    assert [len(b[2]) for b in blocks] == [20, 18]
    grid = T._grown_in_grid(blocks, n, y, 4, cfg)
    monkeypatch.setattr(T, "GRID", 0)
    rows = T._grown_alone(blocks, n, y, 4, cfg)
    assert (grid.feature == rows.feature).all() and (grid.cut == rows.cut).all() and np.allclose(grid.value, rows.value)
    want = sum(rows.values(t, np.ascontiguousarray(bins.T)) for t in range(cfg.trees))
    for most in (1, 12, 1 << 12):
        monkeypatch.setattr(T, "LOOKED_UP", most)
        assert np.allclose(grid.sums(bins, sizes), want)


def test_models_of_many_distinct_rows_grow_without_passes(spark, monkeypatch):
    """The tables that are 60 times sf0.1 have some 7,000,000 distinct rows of bins: these must not be grown by 640 passes."""
    assert T.ALONE > 7_000_000
    _, df = table(spark)
    models = T.fit_boosted(df, SETS | {"none": []}, "y", T.Trees(4, 3, boosting=True, rate=0.3, l2=0.7, least=5))
    got = {(r.id, r.setting): r.predicted for r in T.predict_sets(df, models, ["id"]).collect()}
    for s, m in models.items():
        assert all(np.isclose(got[r.id, s], r.predicted) for r in m.predict(df, ["id"]).collect())
