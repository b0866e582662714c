"""Sums per segment against fits and scores over whole windows; draws against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridra.operators import metrics as M
from veridra.operators import models as R
from veridra.operators import select as S
from veridra.operators import splits as P
from veridra.operators.ranks import quantiles_by
from veridra.plans import q_models
from veridra.sources.workspace import stored


def test_windows_are_runs_of_segments(spark):
    for n, shares in ((4, [0.5, 0.6]), (50, [0.5, 0.6, 0.7, 0.8]), (7, [0.1, 0.15, 0.9])):
        times = spark.createDataFrame([(i, i * 37 % 101) for i in range(n)], "g long, t long")
        segments, windows = P.fold_segments(times, "g", "t", shares, 0.1)
        of = {r.g: r.segment for r in segments.collect()}
        want = {(r.fold, r.part, r.g) for r in P.rolling_folds(times, "g", "t", shares, 0.1).collect()}
        assert {(f, p, g) for g, s in of.items() for f, p, x in windows.table() if x == s} == want


def rows_of(spark, n=600):
    rng = np.random.default_rng(4)
    data = [(int(s), float(a), None if i % 17 == 0 else float(np.round(b)), float(5 + 3 * a - b + e)) for i, (s, a, b, e) in enumerate(zip(rng.integers(0, 5, n), rng.normal(0, 1, n), rng.normal(50, 9, n), rng.normal(0, 1, n)))]
    return data, stored(spark.createDataFrame(data, "segment int, a double, b double, y double"))


WINDOWS = P.Windows([(1, 10, 20), (2, 20, 30), (3, 20, 40)])  # segments 0..4; the tests of folds 2 and 3 overlap


def test_drift_by_fold_equals_drift_over_copied_rows(spark):
    _, df = rows_of(spark)
    table = spark.createDataFrame(WINDOWS.table(), "fold int, part string, segment int")
    want = M.drift(df.join(table, "segment"), ["a", "b"], "part", ["fold"]).orderBy("fold", "feature").collect()
    got = M.drift_by_fold(df, ["a", "b"], "segment", WINDOWS.table()).orderBy("fold", "feature").collect()
    names = ["train_mean", "train_median", "train_p90", "test_mean", "test_median", "test_p90", "mean_diff", "median_diff", "p90_diff", "smd"]
    assert [(r.fold, r.feature) for r in got] == [(r.fold, r.feature) for r in want] and len(got) == 6
    assert np.allclose([[r[c] for c in names] for r in got], [[r[c] for c in names] for r in want])


def test_merged_sums_fit_and_score_like_whole_windows(spark):
    data, df = rows_of(spark)
    df = df.fillna(0.0)
    sums = R.grams(df, ["a", "b"], "y", "segment")
    models: dict = {}
    want = {}
    x = np.array([(r[1], r[2] or 0.0) for r in data])
    y, seg = np.array([r[3] for r in data]), np.array([r[0] for r in data])
    for fold, _, _ in WINDOWS.bounds:
        train, test = (np.isin(seg, WINDOWS.of(fold, p)) for p in ("train", "test"))
        total = None
        for s in WINDOWS.of(fold, "train"):
            total = sums[str(s)] if total is None else total + sums[str(s)]
        own = ((fold, "both"), *R.ridge(total, ["a", "b"], 1.0))
        for s in WINDOWS.of(fold, "test"):
            models.setdefault(str(s), []).append(own)
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x[train] - mean) / sd
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[train] - y[train].mean())) / sd
        e = (x[test] - mean) @ w + y[train].mean() - y[test]
        want[fold] = (test.sum(), np.abs(e).mean(), np.sqrt((e * e).mean()), 1 - (e @ e) / ((y[test] - y[test].mean()) ** 2).sum(), (np.abs(e) <= 0.5).mean(), (np.abs(e) <= 1).mean())
    got = {r.fold: tuple(r)[2:] for r in R.linear_scores(df, ["a", "b"], "y", "segment", models, ["fold", "feature_set"], (0.5, 1.0), float(y.mean())).collect()}
    assert set(got) == set(want)
    for f, v in want.items():
        assert np.allclose(got[f], v)


def test_fold_queries_copy_no_row(spark):
    rows, windows = q_models.fold_rows(spark, "/root/testdata/sf0.001")
    assert rows.count() == q_models.A.model_table(spark, "/root/testdata/sf0.001").count()
    assert len(windows.bounds) == 4 and rows.select("segment").distinct().count() >= 5


def test_quantiles_of_overlapping_unions(spark):
    data, df = rows_of(spark)
    into = (["u"], lambda part: F.when(part["segment"] < 2, F.array(F.struct(F.lit("low").alias("u")), F.struct(F.lit("all").alias("u")))).otherwise(F.array(F.struct(F.lit("all").alias("u")))))
    for per_cell in (5, 10**6):
        got = {r.u: r for r in quantiles_by(df, ["segment"], "b", {"p": 0.3, "q": 0.95}, per_cell, into).collect()}
        for u, keep in (("low", lambda s: s < 2), ("all", lambda s: True)):
            values = [b for s, _, b, _ in data if keep(s) and b is not None]
            assert got[u].n == len(values) and np.allclose([got[u].p, got[u].q], np.quantile(values, [0.3, 0.95]))


def test_quantiles_of_special_values(spark):
    values = [-0.0, 0.0, -1e-310, 1e-310, -1e308, 1e308, float("inf"), float("-inf"), -3.5, -3.5, 2.0]
    df = stored(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"))
    ordered = sorted(values)
    for per_cell in (1, 10**6):
        row = quantiles_by(df, [], "v", {f"q{i}": i / 10 for i in range(11)}, per_cell).first()
        assert [row[f"q{i}"] for i in range(1, 10)] == ordered[1:10] and row.n == 11


@pytest.mark.parametrize("reps", [1, 200])
def test_bootstrap_equals_brute_force_over_the_same_draws(spark, reps):
    import hashlib

    rng = np.random.default_rng(2)
    data = [(s, f"g{g}", i, float(rng.exponential(3 if s == "a" else 4))) for g in range(40) for i in range(1 + g % 4) for s in ("a", "b")]
    df = spark.createDataFrame(data, "setting string, g string, i long, e double")
    got = S.cluster_bootstrap(df, ["g", "i"], "g", "setting", "e", ("a", "b"), reps, 7).first()
    mask = 2**32 - 1

    def mixed(x):
        x ^= x >> 16
        x = x * 2246822507 & mask
        x ^= x >> 13
        x = x * 3266489909 & mask
        return x ^ x >> 16

    sums = {g: [sum(e for s, h, _, e in data if h == g and s == t) for t in ("a", "b")] + [sum(h == g and s == "a" for s, h, _, _ in data)] for g in {r[1] for r in data}}
    values = []
    for rep in range(reps):
        a = b = n = 0.0
        for g, (ga, gb, gn) in sums.items():
            h = hashlib.md5(g.encode()).hexdigest()
            u = mixed(mixed(mixed((rep * 2654435769 + 7) & mask) ^ int(h[:8], 16)) ^ int(h[8:16], 16))
            w = sum(u >= int(p) for p in S.POISSON)
            a, b, n = a + w * ga, b + w * gb, n + w * gn
        values.append((b - a) / n)
    assert np.allclose([got.low, got.high], np.quantile(values, [0.025, 0.975])) and (got.clusters, got.reps) == (40, reps)


def test_draws_are_poisson():
    w = S.draws(1, np.arange(300), np.arange(700) * 7919, np.arange(700) * 104729)
    share = np.bincount(w.astype(int).ravel(), minlength=6)[:6] / w.size
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153, 0.0031], atol=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
