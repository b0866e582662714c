"""Larger tables are dealt into more tasks, and audits move each row once."""

import re

from pyspark.sql import functions as F

from veridra import registry
from veridra.functions import text as X
from veridra.operators import select as S
from veridra.operators import splits as P
from veridra.sources import adapters as A
from veridra.sources import workspace

D = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange (?:hash|RoundRobin)\w*[pP]artitioning\([^\n]*?(\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_tasks_grow_with_lines_and_texts(spark, monkeypatch):
    monkeypatch.setattr(workspace, "TASK_ROWS", 500)
    monkeypatch.setattr(X, "TASK_TEXT", 10_000)
    n = -(-A.table(spark, D, "lineitem").count() // 500)
    assert A.line_tasks(spark, D) == n > 4
    assert set(exchanges(A.item_stats(spark, D))) == {str(n)}
    workspace.forget(spark)
    found = registry.queries()["key_set_difference"](spark, D)
    assert set(exchanges(found)) == {str(n)} and found.count() > 0
    docs = A.docs(spark, D)
    weights = X.tfidf(docs, "doc_id", "text", F.lit(True))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert exchanges(weights).count(str(-(-size // 10_000))) == 2
    workspace.forget(spark)


def test_keys_with_nulls_are_like_no_other(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "z")], "k int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "w")], "k int, t string")
    want = [(2, None, "first"), (2, None, "second"), (3, "z", "first"), (4, "w", "second")]
    for parts in (None, 7):
        assert sorted(map(tuple, S.set_diff(a, b, ["k", "t"], parts).collect()), key=repr) == sorted(want, key=repr)


def test_an_audit_counts_what_is_broken(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (5, None), (None, 5), (6, 40), (6, 40)], "k int, t int")
    split = spark.createDataFrame([(1, "train"), (2, "valid"), (3, "valid"), (3, "train"), (5, "train"), (7, "train"), (None, "train"), (8, "valid"), (8, "valid")], "k int, split_name string")
    for parts in (None, 5):
        got = {r.check: r.violations for r in P.audit_split(df, split, ["k"], "t", parts).collect()}
        assert got == {"unassigned rows": 4, "unknown rows": 4, "duplicate assignments": 2, "empty splits": 1, "shared instants": 2, "order broken": 1}
    one = P.audit_split(df, split, ["k"], "t", 5)
    assert len(exchanges(one)) < 8
