"""Queries over rankings, choices, comparisons, resampling, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridra.operators import checks as K
from veridra.operators import joins as J
from veridra.operators import metrics as M
from veridra.operators import select as S
from veridra.plans.base import query
from veridra.plans.q_metrics import ERRORS, test_errors
from veridra.plans.q_models import REFIT_SQL, metrics, predictions, refit, rounded, stored
from veridra.plans.q_tables import TERMS
from veridra.sources import adapters as A

RANKED = "(SELECT strategy, model_name, v AS valid_mae, t AS test_mae, row_number() OVER (PARTITION BY strategy ORDER BY v, model_name) AS rank FROM (SELECT strategy, model_name, max(mae) FILTER (split_name = 'valid') AS v, max(mae) FILTER (split_name = 'test') AS t FROM metrics GROUP BY 1, 2))"
RANKED_ROWS = "SELECT strategy, model_name, round(valid_mae, 4) AS valid_mae, round(test_mae, 4) AS test_mae, rank"
TWO = {"valid_mae": 4, "test_mae": 4}


def ranked(spark, d):
    return S.validation_ranked(stored(metrics(spark, d)), ["strategy"], "model_name", "mae")


@query("validation_ranked", f"{RANKED_ROWS} FROM {RANKED}")
def _(spark, d):
    return rounded(ranked(spark, d), TWO)


@query("select_rank_one", f"{RANKED_ROWS} FROM {RANKED} WHERE rank = 1")
def _(spark, d):
    return rounded(S.select_best(ranked(spark, d)), TWO)


# The models stand for settings here, the strategy for the candidate: which split strategy suits which model.
@query("locked_report", "SELECT strategy, model_name, split_name, round(mae, 4) AS mae FROM metrics WHERE strategy = (SELECT arg_min(strategy, mae) FROM metrics WHERE model_name = 'mean' AND split_name = 'valid')")
def _(spark, d):
    rows = stored(metrics(spark, d)).withColumn("all", F.lit(1))
    return rounded(S.locked_report(rows, ["all"], "model_name", "strategy", "mae", "mean"), {"mae": 4}).select("strategy", "model_name", "split_name", "mae")


@query("best_by_setting", "SELECT strategy, split_name, arg_min(model_name, mae) AS model_name, round(min(mae), 4) AS mae FROM metrics GROUP BY 1, 2")
def _(spark, d):
    return rounded(S.best_by(metrics(spark, d), ["strategy", "split_name"], "mae", ["model_name"]), {"mae": 4}).select("strategy", "split_name", "model_name", "mae")


@query("best_in_subset", "SELECT strategy, arg_min(model_name, mae) AS model_name, round(min(mae), 4) AS mae FROM metrics WHERE split_name = 'test' AND model_name IN ('mean', 'rank', 'popularity') GROUP BY 1")
def _(spark, d):
    rows = S.best_by(metrics(spark, d), ["strategy"], "mae", ["model_name"], F.col("model_name").isin("mean", "rank", "popularity") & (F.col("split_name") == "test"))
    return rounded(rows, {"mae": 4}).select("strategy", "model_name", "mae")


@query("top_errors", f"SELECT strategy, group_id, line_no, round(absolute_error, 4) AS absolute_error, error_rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(absolute_error, 4) DESC, group_id, line_no) AS error_rank FROM {ERRORS}) WHERE error_rank <= 20")
def _(spark, d):
    return S.top_errors(rounded(test_errors(spark, d), {"absolute_error": 4}), 20, ["strategy"], A.KEYS).select("strategy", *A.KEYS, "absolute_error", "error_rank")


@query("ranked_top_errors", f"SELECT start_time, group_id, line_no, round(absolute_error, 4) AS absolute_error, row_number() OVER (ORDER BY round(absolute_error, 4) DESC, start_time, group_id, line_no) AS error_rank FROM {ERRORS} WHERE strategy = 'forward' ORDER BY error_rank LIMIT 25")
def _(spark, d):
    rows = rounded(test_errors(spark, d).filter("strategy = 'forward'"), {"absolute_error": 4})
    return S.top_errors(rows, 25, [], ["start_time", *A.KEYS]).select("start_time", *A.KEYS, "absolute_error", "error_rank")


@query("top_per_group", "SELECT strategy, model_name, split_name, round(mae, 4) AS mae, rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY mae, model_name, split_name) AS rank FROM metrics) WHERE rank <= 2")
def _(spark, d):
    return rounded(S.best_by(metrics(spark, d), ["strategy"], "mae", ["model_name", "split_name"], k=2), {"mae": 4}).select("strategy", "model_name", "split_name", "mae", "rank")


@query("top_tags", f"SELECT term, df AS n FROM (SELECT * FROM {TERMS} ORDER BY df DESC, term LIMIT 5) ORDER BY df, term")
def _(spark, d):
    return M.array_frequency(A.items(spark, d), "tags").select("term", "n").orderBy(F.desc("n"), "term").limit(5).orderBy("n", "term")


# What the error grows by when a group of features is taken out of the full model.
REMOVED = {"popularity": "rank", "index": "popularity", "all": "mean"}
DROPS = "(SELECT a.strategy, a.split_name, r.removed, a.mae - b.mae AS increase FROM metrics a JOIN metrics b USING (strategy, split_name) JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REMOVED.items()) + ") r(removed, model_name) ON a.model_name = r.model_name WHERE b.model_name = 'full')"


def drops(spark, d):
    rows = S.versus_reference(stored(metrics(spark, d)), ["strategy", "split_name"], "model_name", "mae", "full", list(REMOVED.values()))
    names = F.create_map(*[F.lit(x) for k, v in REMOVED.items() for x in (v, k)])
    return rows.select("strategy", "split_name", F.element_at(names, F.col("model_name")).alias("removed"), F.col("gap").alias("increase"))


@query("argmax_group", f"SELECT strategy, split_name, arg_max(removed, increase) AS removed, round(max(increase), 4) AS increase, CASE WHEN max(increase) <= 0 THEN 'no harmful removal' ELSE '' END AS note FROM {DROPS} GROUP BY 1, 2")
def _(spark, d):
    return rounded(S.argmax_group(drops(spark, d), ["strategy", "split_name"], "removed", "increase"), {"increase": 4})


@query("ablation_drop", f"SELECT strategy, split_name, removed, round(increase, 4) AS increase FROM {DROPS}")
def _(spark, d):
    return rounded(drops(spark, d), {"increase": 4})


@query("mismatch_examples", """WITH c AS (SELECT quantile_cont(label, 0.15::double) AS ylo, quantile_cont(label, 0.85::double) AS yhi, quantile_cont(per_day, 0.15::double) AS xlo, quantile_cont(per_day, 0.85::double) AS xhi FROM aged),
  r AS (SELECT group_id, line_no, label, per_day, CASE WHEN label >= yhi THEN 'high' WHEN label <= ylo THEN 'low' END AS y, CASE WHEN per_day >= xhi THEN 'high' WHEN per_day <= xlo THEN 'low' END AS x FROM aged, c)
  SELECT 'label_' || y || '_rate_' || x AS quadrant, group_id, line_no, label, round(per_day, 9) AS per_day, rank FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY CASE WHEN x = 'high' THEN -per_day ELSE per_day END, CASE WHEN y = 'high' THEN -label ELSE label END, group_id, line_no) AS rank FROM r WHERE x IS NOT NULL AND y IS NOT NULL) WHERE rank <= 10""")
def _(spark, d):
    return rounded(S.mismatch(stored(A.aged(spark, d)), "label", "per_day", 0.85, 10, A.KEYS), {"per_day": 9})


PAIRED = "SELECT a.strategy, a.split_name, a.model_name AS baseline, b.model_name AS comparison, round(a.mae - b.mae, 4) AS change, round(100 * (a.mae - b.mae) / a.mae, 6) AS percent FROM metrics a JOIN metrics b USING (strategy, split_name)"


@query("baseline_improvement", f"SELECT * FROM ({PAIRED}) WHERE split_name = 'test' AND baseline = 'mean' AND comparison IN ('rank', 'popularity', 'full')")
def _(spark, d):
    rows = S.improvement(stored(metrics(spark, d)).filter("split_name = 'test'"), ["strategy", "split_name"], "model_name", "mae", [("mean", "rank"), ("mean", "popularity"), ("mean", "full")])
    return rounded(rows, {"change": 4, "percent": 6}).drop("baseline_value", "comparison_value")


@query("pair_improvement", f"SELECT * FROM ({PAIRED}) WHERE (baseline, comparison) IN (('popularity', 'full'), ('rank', 'full'))")
def _(spark, d):
    rows = S.improvement(stored(metrics(spark, d)), ["strategy", "split_name"], "model_name", "mae", [("popularity", "full"), ("rank", "full")])
    return rounded(rows, {"change": 4, "percent": 6}).drop("baseline_value", "comparison_value")


@query("reference_gap", "SELECT a.strategy, a.split_name, a.model_name, round(a.mae - b.mae, 4) AS gap FROM metrics a JOIN metrics b USING (strategy, split_name) WHERE b.model_name = 'full' AND a.model_name <> 'full'")
def _(spark, d):
    rows = S.versus_reference(stored(metrics(spark, d)), ["strategy", "split_name"], "model_name", "mae", "full")
    return rounded(rows, {"gap": 4}).select("strategy", "split_name", "model_name", "gap")


@query("raw_vs_normalized", "SELECT a.strategy, a.split_name, round(a.mae, 4) AS raw, round(b.mae, 4) AS normalized, round(a.mae - b.mae, 4) AS change, round(100 * (a.mae - b.mae) / a.mae, 6) AS percent FROM metrics a JOIN metrics b USING (strategy, split_name) WHERE a.model_name = 'full' AND b.model_name = 'full_aged'")
def _(spark, d):
    """The full model with popularity as it is against the one with popularity by age."""
    rows = S.improvement(stored(metrics(spark, d)), ["strategy", "split_name"], "model_name", "mae", [("full", "full_aged")])
    rows = rows.select("strategy", "split_name", F.col("baseline_value").alias("raw"), F.col("comparison_value").alias("normalized"), "change", "percent")
    return rounded(rows, {"raw": 4, "normalized": 4, "change": 4, "percent": 6})


@query("paired_cluster_bootstrap", f"""WITH e AS (SELECT group_id, line_no, setting, abs(predicted - actual) AS err FROM ({REFIT_SQL})),
  c AS (SELECT sum(err) FILTER (setting = 'rank') AS a, sum(err) FILTER (setting = 'popularity') AS b, count(*) FILTER (setting = 'rank') AS n,
    CAST('0x' || substr(md5(CAST(group_id AS varchar)), 1, 8) AS ubigint) AS high, CAST('0x' || substr(md5(CAST(group_id AS varchar)), 9, 8) AS ubigint) AS low FROM e GROUP BY group_id),
  r1 AS (SELECT rep, (rep::ubigint * 2654435769::ubigint + 42) & 4294967295::ubigint AS x FROM range(10000) t(rep)),
  r2 AS (SELECT rep, xor(x, x >> 16) * 2246822507::ubigint & 4294967295::ubigint AS x FROM r1), r3 AS (SELECT rep, xor(x, x >> 13) * 3266489909::ubigint & 4294967295::ubigint AS x FROM r2), r AS (SELECT rep, xor(x, x >> 16) AS h FROM r3),
  d1 AS (SELECT rep, a, b, n, low, xor(h, high) AS x FROM r, c), d2 AS (SELECT rep, a, b, n, low, xor(x, x >> 16) * 2246822507::ubigint & 4294967295::ubigint AS x FROM d1),
  d3 AS (SELECT rep, a, b, n, low, xor(x, x >> 13) * 3266489909::ubigint & 4294967295::ubigint AS x FROM d2), d4 AS (SELECT rep, a, b, n, xor(xor(x, x >> 16), low) AS x FROM d3),
  d5 AS (SELECT rep, a, b, n, xor(x, x >> 16) * 2246822507::ubigint & 4294967295::ubigint AS x FROM d4), d6 AS (SELECT rep, a, b, n, xor(x, x >> 13) * 3266489909::ubigint & 4294967295::ubigint AS x FROM d5),
  d AS (SELECT rep, a, b, n, xor(x, x >> 16) AS u FROM d6),
  w AS (SELECT rep, a, b, n, {' + '.join(f'(u >= {int(p)})::int' for p in S.POISSON)} AS w FROM d),
  v AS (SELECT rep, (sum(w * b) - sum(w * a)) / nullif(sum(w * n), 0) AS v FROM w GROUP BY 1)
  SELECT round((SELECT (sum(b) - sum(a)) / sum(n) FROM c), 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high, (SELECT count(*) FROM c) AS clusters, count(*) AS reps FROM v""")
def _(spark, d):
    rows = stored(refit(spark, d).withColumn("absolute_error", F.abs(F.col("predicted") - F.col("actual"))))
    return rounded(S.cluster_bootstrap(rows, A.KEYS, "group_id", "setting", "absolute_error", ("rank", "popularity"), 10_000, 42), {"estimate": 4, "low": 4, "high": 4})


@query("stable_sort", "SELECT group_id, line_no, label FROM items")
def _(spark, d):
    return S.stable_sort(A.items(spark, d).select(*A.KEYS, "label"), ["label"], A.KEYS)


@query("result_projection", "SELECT strategy, model_name, n FROM metrics")
def _(spark, d):
    return S.result_table(metrics(spark, d), ["strategy", "absent", "model_name", "n"], ["strategy", "model_name"])


@query("union_frames", "SELECT model_name, count(*) AS n FROM predictions GROUP BY 1")
def _(spark, d):
    rows = predictions(spark, d)
    return S.union([rows.filter(F.col("strategy") == s) for s in ("forward", "grouped")]).groupBy("model_name").agg(F.count("*").alias("n"))


@query("key_set_difference", "SELECT group_id, line_no, 'first' AS side FROM items ANTI JOIN item_stats USING (group_id, line_no) UNION ALL SELECT group_id, line_no, 'second' FROM item_stats WHERE line_no = 1")
def _(spark, d):
    stats = A.item_stats(spark, d)
    keys, parts = A.items(spark, d).select(*A.KEYS), A.line_tasks(spark, d)
    first = keys.filter("line_no = 1").repartition(parts, *A.KEYS)
    some = keys.filter("line_no <> 1").unionByName(first.join(stats.hint("merge"), A.KEYS, "left_anti"))
    return S.set_diff(some, stats, A.KEYS, parts)


@query("time_set_intersection", "SELECT start_time FROM joined WHERE strategy = 'grouped' AND split_name = 'train' INTERSECT SELECT start_time FROM joined WHERE strategy = 'grouped' AND split_name = 'test'")
def _(spark, d):
    from veridra.plans.q_models import both_splits

    rows = both_splits(spark, d).filter("strategy = 'grouped'")
    return rows.filter("split_name = 'train'").select("start_time").intersect(rows.filter("split_name = 'test'").select("start_time"))


@query("missing_expected", f"SELECT n AS term FROM (VALUES ('red'), ('no such tag')) v(n) WHERE n NOT IN (SELECT term FROM {TERMS})")
def _(spark, d):
    expected = spark.createDataFrame([("red",), ("no such tag",)], "term string")
    return expected.join(M.array_frequency(A.items(spark, d), "tags").hint("merge"), "term", "left_anti")


@query("dedupe_keep_first", "SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return J.dedupe(A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"])


@query("distinct_group_times", "SELECT DISTINCT group_id, start_time FROM model")
def _(spark, d):
    return A.model_table(spark, d).select("group_id", "start_time").distinct()


@query("selection_recheck", "SELECT strategy, model_name, CASE WHEN model_name = 'gone' THEN 'missing' ELSE 'not the lowest' END AS problem FROM (SELECT DISTINCT metrics.strategy, v.c AS model_name FROM metrics, (VALUES ('gone'), ('mean'), ('rank'), ('popularity')) v(c)) ANTI JOIN (SELECT strategy, arg_min(model_name, mae) AS model_name FROM metrics WHERE split_name = 'valid' GROUP BY 1) USING (strategy, model_name)")
def _(spark, d):
    rows = stored(metrics(spark, d)).filter("split_name = 'valid'")
    lock = rows.select("strategy").distinct().withColumn("model_name", F.explode(F.array(*map(F.lit, ("gone", "mean", "rank", "popularity"))))).hint("merge")
    return S.recheck_selection(rows, lock, ["strategy"], "model_name", "mae")


@query("table_diff", "SELECT group_id, line_no, CASE WHEN line_no = 1 THEN 'only in first' WHEN line_no = 2 THEN 'label' ELSE 'item_code' END AS problem FROM items WHERE line_no = 1 OR (line_no = 2 AND label IS NOT NULL) OR line_no = 3")
def _(spark, d):
    a = A.items(spark, d).select(*A.KEYS, "label", "item_code")
    b = a.filter("line_no <> 1").withColumn("label", F.col("label") + F.when(F.col("line_no") == 2, 0.01).otherwise(1e-11)).withColumn("item_code", F.when(F.col("line_no") == 3, F.lit("Z")).otherwise(F.col("item_code")))
    return K.table_diff(a, b, A.KEYS)
