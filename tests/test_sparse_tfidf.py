"""The vocabulary counted as numbers, weights of some documents, and steps of the solver."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from test_ridge_passes import sparse
from veridra.functions import text as X
from veridra.operators import sparse_ridge as S
from veridra.sources.workspace import stored

TEXTS = ["a1 bb cc bb cc", "bb cc dd", None, "", "x", "bb bb bb bb", "éé ÉÉ cc dd dd cc", "cc dd  bb\ncc", "zz yy", "dd cc bb cc dd"]


def test_the_vocabulary_equals_plain_counts(spark):
    lists = [[w for w in (t or "").replace("é", "e").replace("É", "e").split() if len(w) > 1] for t in TEXTS]
    grams = [[*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] for w in lists]
    total, df = Counter(g for x in grams for g in x), Counter(g for x in grams for g in set(x))
    rows = spark.createDataFrame([(w,) for w in lists], "w array<string>").repartition(3)
    for cfg in (X.TfidfConfig(1, 1.0, 1000), X.TfidfConfig(2, 0.4, 3), X.TfidfConfig(99, 1.0, 5)):
        kept = sorted((-total[g], g) for g in total if cfg.min_df <= df[g] <= cfg.max_share * len(TEXTS))[: cfg.max_terms]
        got = {r.term: r.idf for r in X.vocabulary(rows, "w", len(TEXTS), cfg).collect()}
        assert got.keys() == {g for _, g in kept}
        assert all(math.isclose(got[g], math.log((1 + len(TEXTS)) / (1 + df[g])) + 1) for _, g in kept)


def test_weights_of_some_documents_are_those_among_all(spark):
    rows = stored(spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").repartition(3))
    cfg, train = X.TfidfConfig(1, 1.0, 1000), F.col("id") % 10 < 7
    every = {(r.id, r.term): r.weight for r in X.tfidf(rows, "id", "t", train, cfg).collect()}
    some = {(r.id, r.term): r.weight for r in X.tfidf(rows, "id", "t", train, cfg, of=F.col("id") % 2 == 1).collect()}
    assert some == {k: w for k, w in every.items() if k[0] % 2} and len(some) > 5


def test_products_of_large_columns_make_steps_fewer(spark, monkeypatch):
    df, x, y = sparse(spark, 120, 40)
    sets = {"all": [(0, 40)], "some": [(1, 5), (9, 31)], "none": []}
    steps, added = [], S._added
    monkeypatch.setattr(S, "_added", lambda *a: steps.append(1) or added(*a))
    counts = {}
    for most in (0, 10, 512):
        monkeypatch.setattr(S, "EXACT", most)
        for tall in (1, 7, 1 << 11):
            monkeypatch.setattr(S, "TALL", tall)
            del steps[:]
            for s, (w, free) in S.sparse_ridge(df, 40, "y", sets, 0.5, head=2).items():
                at = [i for a, b in sets[s] for i in range(a, b)]
                z = x[:, at] - x[:, at].mean(axis=0)
                want = np.linalg.solve(z.T @ z + 0.5 * np.eye(len(at)), z.T @ (y - y.mean())) if at else np.zeros(0)
                assert np.allclose(w[at], want, atol=1e-5) and np.isclose(free, y.mean() - x[:, at].mean(axis=0) @ want, atol=1e-5)
            counts[most] = len(steps)
    assert counts[512] <= 3 < counts[0]
