"""How often ridge models over sparse rows read them, and rows packed into blocks."""

import numpy as np
from pyspark.sql import functions as F

from veridra import registry
from veridra.operators import encode as E
from veridra.operators import sparse_ridge as S
from veridra.plans import q_models
from veridra.sources.workspace import stored


def sparse(spark, n=120, d=15):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((n, d)) < 0.2, rng.normal(0, 1, (n, d)), 0.0)
    x[7] = 0  # a row without entries
    y = x @ rng.normal(0, 1, d) + 2
    data = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]], float(t)) for r, t in zip(x, y)]
    return stored(spark.createDataFrame([*data, ([3], [1.0], None)], "indices array<int>, values array<double>, y double").repartition(2)), x, y


def test_blocks_of_any_size_and_direct_sums_give_the_same_models(spark, monkeypatch):
    df, x, y = sparse(spark)
    sets = {"all": [(0, 15)], "some": [(2, 5), (9, 12)], "none": []}
    direct = S.gram_ridge(df, 15, "y", sets, 0.5)
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(S, "BLOCK", size)
        for s, (w, free) in S.sparse_ridge(df, 15, "y", sets, 0.5).items():
            assert np.allclose(w, direct[s][0], atol=1e-5) and np.isclose(free, direct[s][1], atol=1e-5)
    z = x - x.mean(axis=0)
    assert np.allclose(direct["all"][0], np.linalg.solve(z.T @ z + 0.5 * np.eye(15), z.T @ (y - y.mean())))
    assert S.gram_ridge(df.limit(0), 15, "y", sets, 0.5)["all"][1] == 0.0


def test_ablation_reads_its_rows_once_and_explodes_no_tags(spark, monkeypatch):
    monkeypatch.setattr(q_models, "sparse_ridge", None)
    assert registry.queries()["ablation_sets"](spark, "/root/testdata/sf0.001").count() == 54
    df = stored(spark.createDataFrame([(1, ["b", "a", "b", "zz"]), (2, []), (3, None), (4, [None, "a"])], "k long, tags array<string>"))
    words = E.array_dictionary(df.filter("k <> 1 or true").select("k", F.array_except("tags", F.array(F.lit("zz"))).alias("tags")), "tags")
    coded = E.encode_array(df, ["k"], "tags", words)
    assert "Generate" not in coded._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(E, "how", lambda words: "merge")
    want = {r.k: r.places for r in E.encode_array(df, ["k"], "tags", words.filter("term is not null")).collect()}
    assert {r.k: r.places for r in coded.collect()} == want
