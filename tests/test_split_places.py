"""Splits compare each row with two places of the order; rows are not moved, and metrics store nothing of them."""

import re
from decimal import Decimal
from hashlib import md5

from pyspark.sql import functions as F

from veridra import registry
from veridra.operators import splits as P
from veridra.plans import q_models
from veridra.sources import adapters as A

D = "/root/testdata/sf0.001"
RATIOS = (0.7, 0.15, 0.15)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wanted(keys, place):
    """Key -> split, from a plain sort of the distinct keys."""
    order = sorted(set(keys), key=place)
    n = len(order)
    floors, rests = [n * p // 100 for p in (70, 15, 15)], [n * p % 100 for p in (70, 15, 15)]
    for i in sorted(range(3), key=lambda i: (-rests[i], i))[: n - sum(floors)]:
        floors[i] += 1
    return {k: P.NAMES[(i >= floors[0]) + (i >= floors[0] + floors[1])] for i, k in enumerate(order)}


def test_splits_move_no_row(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = A.model_table(spark, D)
        for split in (P.group_split(rows, "group_id", RATIOS, 42), P.time_split(rows, "start_time", RATIOS)):
            assert "hashpartitioning" not in plan(split) and "SortMergeJoin" not in plan(split)
            assert split.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_metrics_store_no_row_and_read_it_where_it_lies(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q_models, "stored", lambda df, *a: seen.append(df.columns) or df)
    found = registry.queries()["metrics_by_split"](spark, D)
    assert not seen and found.count() == 30
    assert len(re.findall(r"Scan parquet spark_catalog", plan(found).split("Initial Plan")[0])) == 1


def test_splits_equal_a_plain_sort_for_keys_of_any_kind(spark):
    kinds = {
        "long": list(range(-40, 60)), "string": [f"g{i}" for i in range(41)] + ["", "é", "Z"], "decimal(12,2)": [Decimal(i) / 4 for i in range(53)], "date": [f"20{i:02}-02-03" for i in range(30)],
        "timestamp_ntz": [f"2021-03-28 02:{i:02}:00" for i in range(60)], "double": [i / 8 for i in range(19)],
    }
    for kind, keys in kinds.items():
        df = spark.createDataFrame([(str(k), i) for k in keys for i in range(3)], "k string, i int").withColumn("k", F.col("k").cast(kind)).withColumn("s", F.col("k").cast("string"))
        text = {r.s: r.k for r in df.select("k", "s").distinct().collect()}
        by_hash = wanted(text, lambda s: md5(f"42:{s}".encode()).hexdigest())
        assert {r.s: r.split_name for r in P.group_split(df, "k", RATIOS, 42).collect()} == by_hash
        by_time = wanted(text, lambda s: text[s].encode() if kind == "string" else text[s])
        assert {r.s: r.split_name for r in P.time_split(df, "k", RATIOS).collect()} == by_time
        assert P.group_split(df, "k", RATIOS, 42).count() == 3 * len(keys)


def test_rows_without_a_group_are_dropped_and_zeros_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (0.0, 1), (-0.0, 2), *((float(i), 3) for i in range(1, 20))], "g double, i int")
    for seed in range(4):
        split = P.group_split(df, "g", RATIOS, seed).collect()
        assert len(split) == 21 and len({r.split_name for r in split if r.g == 0}) == 1
        assert all(P.NAMES[r.fold] == r.split_name for r in split)
