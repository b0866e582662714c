"""Dictionaries as tables, sparse rows, and the solver over them."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veridra.operators import encode as E
from veridra.operators.sparse_ridge import predict_sparse, sparse_ridge
from veridra.sources.workspace import stored


def test_places_go_by_frequency_and_ties_by_name(spark):
    rows = [("b", "x"), ("b", "x"), ("a", None), ("a", "y"), (None, "y"), ("c", "z")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = {(r.feature, r.category): (r.n, r.place) for r in E.dictionary(df, ["s", "t"]).collect()}
    assert got == {("s", "a"): (2, 0), ("s", "b"): (2, 1), ("s", "__missing__"): (1, 2), ("s", "c"): (1, 3), ("t", "x"): (2, 0), ("t", "y"): (2, 1), ("t", "__missing__"): (1, 2), ("t", "z"): (1, 3)}


def test_sparse_rows_equal_plain_python(spark):
    rows = [("a", 1.0, 10), ("b", None, 20), (None, 3.0, None), ("a", 8.0, 40)]
    train = stored(spark.createDataFrame(rows, "t string, v double, w int"))
    more = spark.createDataFrame([*rows, ("new", 2.0, 5)], "t string, v double, w int")
    e = E.fit_encoding(train, ["v", "t", "w"])
    assert e.ranges == {"v": (0, 1), "w": (1, 2), "t": (2, 5)} and e.size == 5
    v, w = np.array([1.0, 3.0, 3.0, 8.0]), np.array([10.0, 20.0, 20.0, 40.0])
    at = {"a": 2, "__missing__": 3, "b": 4}
    for r in E.encoded(more, e).collect():
        want = {0: ((3.0 if r.v is None else r.v) - v.mean()) / v.std(), 1: ((20.0 if r.w is None else r.w) - w.mean()) / w.std()}
        if (r.t or "__missing__") in at:
            want[at[r.t or "__missing__"]] = 1.0
        assert dict(zip(r.indices, r["values"])) == pytest.approx({k: x for k, x in want.items() if x})
    dense = E.with_vector(more, e).select("t", vector_to_array("x").alias("x")).collect()
    assert all(len(r.x) == 5 for r in dense) and [sum(r.x[2:]) for r in dense if r.t == "new"] == [0.0]


def test_many_categories_stay_a_table(spark, monkeypatch):
    n = 200_000
    df = stored(spark.range(n * 2).select(F.concat(F.lit("category of some length "), F.when(F.col("id") < n, F.col("id")).otherwise(0)).alias("t"), F.col("id").cast("double").alias("v")))
    taken, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (lambda rows: taken.append(len(rows)) or rows)(collect(self)))
    e = E.fit_encoding(df, ["v", "t"])
    assert e.sizes == {"t": n} and e.size == n + 1 and e.hint == "broadcast" and max(taken) < 10
    row = E.encoded(df.filter("v = 5"), e).first()
    assert len(row.indices) == 2 and row.indices[0] == 0
    assert E.encoded(df.filter(f"v = {n + 7}"), e).first().indices[1] == 1  # the hot category comes first
    monkeypatch.setattr(E, "how", lambda words: "merge")
    again = E.fit_encoding(df, ["t"])
    assert again.hint == "merge" and E.encoded(df, again).agg(F.countDistinct("indices")).first()[0] == n


def test_arrays_and_back(spark):
    rows = [(1, ["b", "a"]), (2, ["a"]), (3, []), (4, None), (5, ["c", "c", "a"])]
    df = spark.createDataFrame(rows, "k long, tags array<string>")
    words = E.array_dictionary(df, "tags")
    assert {r.term: (r.n, r.place) for r in words.collect()} == {"a": (3, 0), "b": (1, 1), "c": (1, 2)}
    coded = E.encode_array(df, ["k"], "tags", words)
    assert {r.k: r.places for r in coded.collect()} == {1: [0, 1], 2: [0], 3: [], 4: [], 5: [0, 2]}
    assert {r.k: r.tags for r in E.decode_array(coded, ["k"], "places", words).collect()} == {1: ["a", "b"], 2: ["a"], 3: [], 4: [], 5: ["a", "c"]}


def test_sparse_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    n, d = 300, 40
    x = np.where(rng.random((n, d)) < 0.15, rng.normal(0, 1, (n, d)), 0.0)
    x[:, 0], x[:, 1] = rng.normal(0, 30, n), 0
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, n)  # two numbers that grow together
    y = x @ rng.normal(0, 1, d) + 5 + rng.normal(0, 0.3, n)
    data = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]], float(t)) for r, t in zip(x, y)]
    df = stored(spark.createDataFrame([*data, ([3], [1.0], None)], "indices array<int>, values array<double>, y double").repartition(3))
    sets = {"all": [(0, d)], "some": [(0, 2), (10, 25)], "none": []}
    models = sparse_ridge(df, d, "y", sets, 0.5, head=2)
    for s, ranges in sets.items():
        at = [i for a, b in ranges for i in range(a, b)]
        z = x[:, at] - x[:, at].mean(axis=0)
        w = np.linalg.solve(z.T @ z + 0.5 * np.eye(len(at)), z.T @ (y - y.mean())) if at else np.zeros(0)
        got, free = models[s]
        assert np.allclose(got[at], w, atol=1e-4) and np.isclose(free, y.mean() - x[:, at].mean(axis=0) @ w, atol=1e-3)
        assert not np.delete(got, at).any()
    long = predict_sparse(df.withColumn("k", F.monotonically_increasing_id()), models, ["k", "y"])
    assert long.count() == 3 * 301
    e = [abs(r.predicted - r.y) for r in long.filter("setting = 'all' and y is not null").collect()]
    assert np.isclose(np.mean(e), np.abs(x @ models["all"][0] + models["all"][1] - y).mean())
    with pytest.raises(ValueError, match="steps"):
        sparse_ridge(df, d, "y", sets, 0.5, steps=2)
    assert sparse_ridge(df.limit(0), d, "y", sets, 0.5)["all"][1] == 0.0
