"""Queries over joins with declared cardinality."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridra.operators import checks as K
from veridra.operators import joins as J
from veridra.plans.base import query
from veridra.plans.q_models import forward_split, metrics, predictions, stored
from veridra.sources import adapters as A


@query("unique_key_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return K.duplicate_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("left_join_many_one", "SELECT group_id, line_no, popularity, group_type, start_time FROM merged")
def _(spark, d):
    rows = J.left_join(A.items(spark, d), A.item_stats(spark, d), A.KEYS)
    return J.left_join(rows, A.groups(spark, d), ["group_id"]).select(*A.KEYS, "popularity", "group_type", "start_time")


@query("left_join_one_one", "SELECT group_id, line_no, label, popularity AS stats_popularity FROM items LEFT JOIN item_stats USING (group_id, line_no)")
def _(spark, d):
    return J.left_join(A.items(spark, d), A.item_stats(spark, d), A.KEYS, prefix="stats_", validate="1:1").select(*A.KEYS, "label", "stats_popularity")


@query("inner_join_complete", "SELECT group_id, line_no, label, split_name FROM model JOIN time_split USING (group_id, line_no)")
def _(spark, d):
    rows = forward_split(spark, d, *A.KEYS, "start_time", "label")
    return J.join_split(rows.drop("split_name", "fold"), rows.select(*A.KEYS, "split_name"), A.KEYS).select(*A.KEYS, "label", "split_name")


@query("left_join_complete", "SELECT group_id, line_no, label, split_name FROM model JOIN time_split USING (group_id, line_no)")
def _(spark, d):
    rows = forward_split(spark, d, *A.KEYS, "start_time", "label")
    return J.join_split(rows.drop("split_name", "fold"), rows.select(*A.KEYS, "split_name"), A.KEYS, how="left").select(*A.KEYS, "label", "split_name")


@query("dedupe_join_counts", """SELECT count(*) FILTER (i.group_id IS NOT NULL AND s.group_id IS NOT NULL) AS matched_left, count(*) FILTER (s.group_id IS NULL) AS unmatched_left, count(*) FILTER (i.group_id IS NULL) AS unmatched_right
FROM items i FULL JOIN (SELECT * FROM item_stats WHERE line_no > 1 UNION ALL SELECT -1, 1, 0) s ON i.group_id = s.group_id AND i.line_no = s.line_no""")
def _(spark, d):
    stats = A.item_stats(spark, d).filter("line_no > 1")
    more = stats.withColumn("popularity", F.col("popularity") + 1)
    extra = spark.createDataFrame([(-1, 1, 0)], stats.schema)
    twice = stats.unionByName(more).unionByName(extra).withColumn("group_id", F.concat("group_id", F.lit(".0")))
    return J.enrich(A.items(spark, d), twice, A.KEYS, ["popularity"])[1]


@query("aux_join_projection", "SELECT CAST(group_id AS varchar) AS group_id, CAST(line_no AS varchar) AS line_no, item_code, popularity FROM items LEFT JOIN item_stats USING (group_id, line_no)")
def _(spark, d):
    stats = A.item_stats(spark, d).withColumn("unused", F.lit(1))
    return J.enrich(A.items(spark, d).select(*A.KEYS, "item_code"), stats, A.KEYS, ["popularity"], ["popularity"])[0]


@query("split_join_normalized", "SELECT CAST(group_id AS varchar) AS group_id, CAST(line_no AS varchar) AS line_no, split_name FROM time_split")
def _(spark, d):
    rows = forward_split(spark, d)
    split = rows.select(F.col("group_id").cast("double").alias("group_id"), F.col("line_no").cast("string").alias("line_no"), "split_name")
    return J.join_split(rows.select(*A.KEYS), split, A.KEYS, normalize=True)


@query("anti_join_unmatched", "SELECT group_id, line_no FROM items ANTI JOIN item_stats USING (group_id, line_no)")
def _(spark, d):
    return J.unmatched(A.item_stats(spark, d), A.items(spark, d), A.KEYS)


@query("exclude_known", "SELECT group_id, line_no, label FROM model WHERE line_no <> 6")
def _(spark, d):
    rows = A.model_table(spark, d)
    return J.exclude(rows, rows.filter("line_no = 6").select(*A.KEYS), A.KEYS).select(*A.KEYS, "label")


@query("semi_join_selected", "SELECT strategy, model_name, split_name, n FROM metrics SEMI JOIN (SELECT strategy, arg_min(model_name, mae) AS model_name FROM metrics WHERE split_name = 'valid' GROUP BY 1) USING (strategy, model_name)")
def _(spark, d):
    rows = stored(metrics(spark, d))
    best = rows.filter("split_name = 'valid'").groupBy("strategy").agg(F.min_by("model_name", "mae").alias("model_name"))
    return J.keep_selected(rows, best, ["strategy", "model_name"]).select("strategy", "model_name", "split_name", "n")


@query("many_one_enrich", "SELECT strategy, model_name, split_name, index_rank, count(*) AS n, round(sum(predicted - actual), 2) + 0.0::double AS error, round(sum(abs(predicted - actual)), 2) AS absolute_error FROM predictions JOIN (SELECT group_id, line_no, index_rank FROM model) USING (group_id, line_no) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    rows = J.enrich_predictions(predictions(spark, d), A.model_table(spark, d).select(*A.KEYS, "index_rank"), A.KEYS)
    return rows.groupBy("strategy", "model_name", "split_name", "index_rank").agg(F.count("*").alias("n"), (F.round(F.sum("error"), 2) + F.lit(0.0)).alias("error"), F.round(F.sum("absolute_error"), 2).alias("absolute_error"))


@query("column_fallback_join", "SELECT group_id, start_time FROM items JOIN groups_ USING (group_id) WHERE line_no = 1")
def _(spark, d):
    return J.source_column(A.items(spark, d).filter("line_no = 1"), A.groups(spark, d), "start_time", ["group_id"])


@query("time_consistency_join", "SELECT group_id, start_time AS x, CASE WHEN group_id % 7 = 0 THEN start_time + 1 END AS y FROM groups_ WHERE group_id % 7 = 0 OR group_id % 11 = 0")
def _(spark, d):
    g = A.groups(spark, d)
    moved = F.when(F.col("group_id") % 7 == 0, F.col("start_time") + 1).when(F.col("group_id") % 11 != 0, F.col("start_time"))
    return J.assert_equal(g, g.withColumn("start_time", moved), ["group_id"], "start_time")


@query("report_self_join", "SELECT a.strategy, a.model_name, round(a.mae, 4) AS valid_mae, round(b.mae, 4) AS test_mae FROM metrics a JOIN metrics b ON a.strategy = b.strategy AND a.model_name = b.model_name WHERE a.split_name = 'valid' AND b.split_name = 'test'")
def _(spark, d):
    rows = stored(metrics(spark, d))
    valid, test = (rows.filter(F.col("split_name") == s).select("strategy", "model_name", F.round("mae", 4).alias(f"{s}_mae")) for s in ("valid", "test"))
    return valid.join(test, ["strategy", "model_name"])


@query("variant_key_join", """SELECT key, CASE i % 4 WHEN 0 THEN key WHEN 1 THEN upper(key) WHEN 2 THEN lower(key) END AS page_key, CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS match
FROM (SELECT o_orderkey AS i, 'Page' || o_orderkey AS key FROM orders)""")
def _(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.concat(F.lit("Page"), "o_orderkey").alias("key"))
    kind = F.col("i") % 4
    pages = rows.filter(kind < 3).select(F.when(kind == 0, F.col("key")).when(kind == 1, F.upper("key")).otherwise(F.lower("key")).alias("key"))
    worse = rows.filter(kind == 0).select(F.lower("key").alias("key"))
    return J.variant_join(rows.select("key"), pages.union(worse), "key").select("key", "page_key", "match")
