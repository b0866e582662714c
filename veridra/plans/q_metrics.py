"""Queries over error tables, profiles, coverage and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridra.operators import joins as J
from veridra.operators import metrics as M
from veridra.operators import normalize as N
from veridra.operators.ranks import quantiles_by
from veridra.plans.base import query
from veridra.plans.q_models import BANDS, FIGURES, ROUNDED, both_splits, forward_split, metrics, predictions, rounded, stored
from veridra.plans.q_tables import BOUNDS, BUCKET_SQL, BUCKETS, TERMS
from veridra.sources import adapters as A


@query("regression_metrics", "SELECT model_name, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse FROM predictions GROUP BY 1")
def _(spark, d):
    return rounded(M.regression_metrics(predictions(spark, d), "actual", "predicted", ["model_name"], BANDS), FIGURES).select("model_name", "n", "mae", "rmse")


@query("metrics_by_split", f"SELECT strategy, model_name, split_name, n, {ROUNDED} FROM metrics")
def _(spark, d):
    return rounded(metrics(spark, d), FIGURES)


@query("metrics_by_age_bucket", f"SELECT model_name, {BUCKET_SQL} AS age_bucket, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae FROM predictions JOIN (SELECT group_id, line_no, age_days FROM aged) USING (group_id, line_no) WHERE split_name = 'test' GROUP BY 1, 2")
def _(spark, d):
    ages = A.aged(spark, d).select(*A.KEYS, N.bucket(F.col("age_days"), BOUNDS, BUCKETS).alias("age_bucket"))
    rows = predictions(spark, d).filter("split_name = 'test'").join(ages, A.KEYS)
    return rounded(M.regression_metrics(rows, "actual", "predicted", ["model_name", "age_bucket"], BANDS), FIGURES).select("model_name", "age_bucket", "n", "mae")


def test_errors(spark, d):
    """Test errors of the rank means with item features."""
    features = A.model_table(spark, d).select(*A.KEYS, "index_rank", "tags")
    return J.enrich_predictions(predictions(spark, d, "rank").filter("split_name = 'test'"), features, A.KEYS)


ERRORS = "(SELECT p.*, abs(predicted - actual) AS absolute_error, index_rank, tags FROM predictions p JOIN (SELECT group_id, line_no, index_rank, tags FROM model) USING (group_id, line_no) WHERE model_name = 'rank' AND split_name = 'test')"


@query("error_by_tag", f"SELECT strategy, term, count(*) AS n, round(avg(absolute_error), 4) AS mean_error FROM (SELECT strategy, absolute_error, unnest(tags) AS term FROM {ERRORS}) GROUP BY 1, 2 HAVING count(*) >= 30")
def _(spark, d):
    return rounded(M.error_by_array(test_errors(spark, d), "tags", ["strategy"], 30), {"mean_error": 4})


@query("error_by_rank", f"SELECT strategy, index_rank, count(*) AS n, round(avg(absolute_error), 4) AS mean_error FROM {ERRORS} GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.error_by(test_errors(spark, d), ["strategy", "index_rank"]), {"mean_error": 4})


@query("tag_frequency", f"SELECT term, df AS n, round(df / (SELECT count(*) FROM items), 6) AS share FROM {TERMS}")
def _(spark, d):
    return rounded(M.array_frequency(A.items(spark, d), "tags"), {"share": 6})


@query("index_distribution", "SELECT index_rank, index_letter, count(*) AS n, round(avg(label), 3) AS mean, round(median(label), 3) AS median, round(count(*) / (SELECT count(*) FROM model), 6) AS share FROM model GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.group_profile(A.model_table(spark, d), ["index_rank", "index_letter"], "label"), {"mean": 3, "median": 3, "share": 6})


@query("rating_bands", "SELECT CAST(floor(label / 5000) * 5000 AS bigint) AS band, CAST(floor(label / 5000) * 5000 AS bigint) || '-' || CAST(floor(label / 5000) * 5000 + 4999 AS bigint) AS label, min(label) AS low, max(label) AS high, count(*) AS n, median(popularity) AS median_popularity, round(avg(tag_count), 6) AS mean_tags, round(count(*) / (SELECT count(*) FROM model), 6) AS share FROM model m GROUP BY floor(m.label / 5000)")
def _(spark, d):
    return rounded(M.banded_profile(A.model_table(spark, d), "label", 5000, "popularity", "tag_count"), {"share": 6, "mean_tags": 6})


QS = [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


@query("quantile_summary", "SELECT q, round(v, 3) AS value FROM (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99, 1.0]::double[]) AS q, unnest(quantile_cont(label, [0.5, 0.75, 0.9, 0.95, 0.99, 1.0])) AS v FROM model)")
def _(spark, d):
    return rounded(M.quantiles(A.model_table(spark, d), "label", QS), {"value": 3})


@query("feature_distribution", "SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, max(v) AS max FROM (SELECT 'popularity' AS feature, CAST(popularity AS double) AS v FROM model UNION ALL SELECT 'tag_count', tag_count FROM model) GROUP BY 1")
def _(spark, d):
    return rounded(M.describe_long(A.model_table(spark, d), ["popularity", "tag_count"]), {"mean": 6})


@query("dataset_summary", """SELECT count(*) AS n, count(DISTINCT group_id) AS n_groups, min(label) AS label_min, max(label) AS label_max, round(avg(label), 3) AS label_mean, round(median(label), 3) AS label_median, count(*) FILTER (popularity_missing = 1) AS no_popularity,
  round(quantile_cont(popularity, 0.9), 3) AS p90, round(quantile_cont(popularity, 0.99), 3) AS p99, (SELECT string_agg(term, ',' ORDER BY n DESC, term) FROM (SELECT term, count(*) AS n FROM (SELECT unnest(tags) AS term FROM model) GROUP BY 1 ORDER BY n DESC, term LIMIT 3)) AS top_tags FROM model""")
def _(spark, d):
    rows = stored(A.model_table(spark, d).select("group_id", "label", "popularity", "popularity_missing", "tags"))
    top = M.array_frequency(rows, "tags").orderBy(F.desc("n"), "term").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), lambda x: x["term"]), ",").alias("top_tags"))
    numbers = rows.agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), F.min("label").alias("label_min"), F.max("label").alias("label_max"), F.round(F.avg("label"), 3).alias("label_mean"), F.count_if(F.col("popularity_missing") == 1).alias("no_popularity"))
    label, popularity = quantiles_by(rows, [], "label", {"median": 0.5}).first(), quantiles_by(rows, [], "popularity", {"p90": 0.9, "p99": 0.99}).first()
    made = {"label_median": label.median, "p90": popularity.p90, "p99": popularity.p99}
    return numbers.withColumns({k: F.round(F.lit(v), 3) for k, v in made.items()}).withColumn("top_tags", F.lit(top.first()[0]))


@query("split_sizes", "SELECT strategy, split_name, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM joined GROUP BY 1, 2")
def _(spark, d):
    return M.split_sizes(both_splits(spark, d), "group_id", ["strategy", "split_name"])


@query("group_overlap", "SELECT source, lang, count(DISTINCT doc_id % 3) AS n_splits FROM docs_ GROUP BY 1, 2 HAVING count(DISTINCT doc_id % 3) > 1")
def _(spark, d):
    split = A.docs(spark, d).withColumn("split_name", F.col("doc_id") % 3)
    return M.group_overlap(split, "source", ["lang"])


@query("split_time_ranges", "SELECT split_name, min(start_time) AS first, max(start_time) AS last, true AS strict_order FROM joined WHERE strategy = 'forward' GROUP BY 1")
def _(spark, d):
    return M.split_ranges(forward_split(spark, d), "start_time")


@query("correlation_by_scope", f"""WITH long AS (SELECT {BUCKET_SQL} AS b, label, 'popularity' AS signal, CAST(popularity AS double) AS v FROM aged UNION ALL SELECT {BUCKET_SQL}, label, 'per_day', per_day FROM aged)
  SELECT coalesce(b, 'overall') AS scope, signal, count(*) AS n, round(corr(label, v), 6) AS correlation FROM long GROUP BY GROUPING SETS ((signal), (b, signal))""")
def _(spark, d):
    rows = A.aged(spark, d).withColumn("age_bucket", N.bucket(F.col("age_days"), BOUNDS, BUCKETS))
    return rounded(M.correlations(rows, "label", ["popularity", "per_day"], "age_bucket"), {"correlation": 6})


@query("coverage_by_split", "SELECT coalesce(split_name, 'overall') AS split_name, count(*) AS n, count(DISTINCT group_id) AS n_groups, count(DISTINCT start_time) AS n_times, count(*) FILTER (has_points = 1) AS parsed, round(count(*) FILTER (has_points = 1) / count(*), 6) AS coverage FROM joined WHERE strategy = 'forward' GROUP BY ROLLUP (split_name)")
def _(spark, d):
    return rounded(M.coverage(forward_split(spark, d).withColumn("parsed_ok", F.col("has_points") == 1), "split_name", "group_id", "start_time", "parsed_ok"), {"coverage": 6})


@query("bucket_counts_filled", f"SELECT l.label, l.position, coalesce(n, 0) AS n FROM (VALUES ('0-1y', 0), ('1-3y', 1), ('3-5y', 2), ('5y+', 3), ('never', 4)) l(label, position) LEFT JOIN (SELECT {BUCKET_SQL} AS label, count(*) AS n FROM aged GROUP BY 1) USING (label)")
def _(spark, d):
    rows = A.aged(spark, d).withColumn("age_bucket", N.bucket(F.col("age_days"), BOUNDS, BUCKETS))
    return M.counts_filled(rows, "age_bucket", [*BUCKETS, "never"])


GAPS = "(SELECT strategy, model_name, max(mae) FILTER (split_name = 'train') AS train, max(mae) FILTER (split_name = 'test') AS test FROM metrics GROUP BY 1, 2)"


@query("train_test_gap", f"SELECT strategy, model_name, round(test - train, 4) AS gap, round(test / train, 6) AS ratio, test - train > greatest(50, 0.005 * train) AS flagged FROM {GAPS}")
def _(spark, d):
    return rounded(M.gap_summary(metrics(spark, d), ["strategy", "model_name"], share=0.005), {"gap": 4, "ratio": 6}).select("strategy", "model_name", "gap", "ratio", "flagged")


@query("gap_category", f"SELECT strategy, model_name, CASE WHEN NOT test - train > greatest(10, 0.0001 * train) THEN 'none' WHEN model_name = 'mean' THEN 'baseline' WHEN strategy = 'forward' THEN 'temporal' ELSE 'overfitting' END AS category FROM {GAPS}")
def _(spark, d):
    gaps = M.gap_summary(metrics(spark, d), ["strategy", "model_name"], floor=10, share=0.0001)
    return M.gap_category(gaps, baselines=("mean",)).select("strategy", "model_name", "category")


@query("column_profile", "SELECT 'orders' AS \"table\", c AS \"column\", false AS has_nulls FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) v(c) UNION ALL SELECT 'items', c, c IN ('label', 'points') FROM (VALUES ('group_id'), ('item_code'), ('line_no'), ('item_name'), ('item_type'), ('label'), ('points'), ('tags')) v(c)")
def _(spark, d):
    return M.data_dictionary({"orders": A.table(spark, d, "orders"), "items": A.items(spark, d)}).drop("type")


WORD = "[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*"


@query("word_count_mixed", f"SELECT doc_id, len(regexp_extract_all(t, '{WORD}')) + len(regexp_extract_all(t, '[一-鿿]')) AS n_words FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```|`[^`]*`', ' ', 'g'), 'https?://\\S+', ' ', 'g') AS t FROM documents)")
def _(spark, d):
    return A.docs(spark, d).select("doc_id", M.word_count(F.col("text")).cast("long").alias("n_words"))


HIST = "(SELECT ln(1 + popularity) AS v FROM model)"


@query("histogram_input", f"SELECT least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS bigint), 9) AS bin, count(*) AS n FROM (SELECT least(v, (SELECT quantile_cont(v, 0.99) FROM {HIST})) AS v FROM {HIST}), (SELECT min(least(v, q)) AS lo, max(least(v, q)) AS hi FROM {HIST}, (SELECT quantile_cont(v, 0.99) AS q FROM {HIST})) GROUP BY 1")
def _(spark, d):
    return M.histogram(A.model_table(spark, d), "popularity", 10, "log1p", 0.99)[0].select("bin", "n")


@query("box_stats", "SELECT index_rank, index_letter, count(label) AS n, min(label) AS min, round(quantile_cont(label, 0.25), 4) AS q1, round(quantile_cont(label, 0.5), 4) AS median, round(quantile_cont(label, 0.75), 4) AS q3, max(label) AS max FROM model GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.box_stats(A.model_table(spark, d), ["index_rank", "index_letter"], "label"), {"q1": 4, "median": 4, "q3": 4})
