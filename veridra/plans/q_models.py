"""Queries over splits, fits and their scores."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyspark.sql.functions as F
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from veridra.operators import joins as J
from veridra.operators import metrics as M
from veridra.operators import models as R
from veridra.operators import splits as P
from veridra.operators import trees as T
from veridra.operators.encode import array_dictionary, encode_array, encoded, fit_encoding
from veridra.operators.select import residual_interval, union, validation_ranked
from veridra.operators.sparse_ridge import gram_ridge, predict_sparse, sparse_ridge
from veridra.plans.base import query
from veridra.sources import adapters as A
from veridra.sources.workspace import stored

RATIOS = (0.7, 0.15, 0.15)
SEED = 42
BANDS = (10_000, 20_000)


def _two_splits(spark, d, *columns: str, table: Callable[..., DataFrame] = A.aged) -> DataFrame:
    """The model table with ages (or some of its columns), its split of either strategy beside each row."""
    rows = table(spark, d)
    rows = rows.select(*columns) if columns else rows
    beside = lambda df, s: df.withColumn(f"_{s}", F.struct(F.lit(s).alias("strategy"), "fold", "split_name")).drop("fold", "split_name")
    return beside(P.group_split(beside(P.time_split(rows, "start_time", RATIOS), "forward"), "group_id", RATIOS, SEED), "grouped")


def _per_strategy(rows: DataFrame) -> DataFrame:
    """A row per strategy, made as the rows are read."""
    return rows.select(*(c for c in rows.columns if c not in ("_forward", "_grouped")), F.inline(F.array("_forward", "_grouped")))


def both_splits(spark, d, *columns: str) -> DataFrame:
    """The model table with ages (or some of its columns) once per strategy, with its split; stored once for both."""
    return _per_strategy(stored(_two_splits(spark, d, *columns)))


def forward_split(spark, d, *columns: str) -> DataFrame:
    """The model table (or some of its columns) with its forward split, stored."""
    rows = A.model_table(spark, d)
    return stored(P.time_split(rows.select(*columns) if columns else rows, "start_time", RATIOS))


#: feature sets of the studies' ridge models; the last one has popularity by age
SETS = {"mean": [], "rank": ["index_rank"], "popularity": ["log_popularity"], "full": ["index_rank", "log_popularity"], "full_aged": ["index_rank", "log_per_day"]}


FEATURES = ["index_rank", "log_popularity", "log_per_day"]


def train_sums(rows: DataFrame) -> dict[str, R.Gram]:
    """The sums of each strategy's train rows, from one pass."""
    return R.grams(rows.filter("split_name = 'train'"), FEATURES, "label", "strategy")


def predictions(spark, d, *models: str) -> DataFrame:
    """Long predictions of a ridge model per feature set (or some of them) and strategy, made from the stored rows as they are read: several rows for each of those,
    so they are not written."""
    rows = both_splits(spark, d, *A.KEYS, "item_code", "start_time", "label", *FEATURES)
    train = train_sums(rows)
    sets = {k: SETS[k] for k in models or SETS}
    return R.predict_by(rows, train, "strategy", sets, 1.0, ["strategy", "split_name", "group_id", "line_no", "item_code", "start_time"], "label")


def metrics(spark, d) -> DataFrame:
    """Scores of the same models, as sums over the stored items as they are read: neither their splits nor a prediction is written."""
    rows = _per_strategy(_two_splits(spark, d, "group_id", "start_time", "label", *FEATURES))
    train = train_sums(rows)
    solved = {s: [(name, *R.ridge(g, x, 1.0)) for name, x in SETS.items()] for s, g in train.items()}
    models = {f"{s}/{split}": [((s, name, split), w, b) for name, w, b in own] for s, own in solved.items() for split in P.NAMES}
    centre = float(next(iter(train.values())).shift[-1])
    return R.linear_scores(rows.withColumn("part", F.concat_ws("/", "strategy", "split_name")), FEATURES, "label", "part", models, ["strategy", "model_name", "split_name"], BANDS, centre)


ROUNDED = "round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) + 0.0::double AS r2, round(within_1, 6) AS within_1, round(within_2, 6) AS within_2"


def rounded(df: DataFrame, names: dict[str, int]) -> DataFrame:
    # adding zero makes -0.0 and 0.0 one value
    return df.withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in names.items()})


FIGURES = {"mae": 4, "rmse": 4, "r2": 6, "within_1": 6, "within_2": 6}


@query("flagship", f"SELECT strategy, model_name, split_name, n, {ROUNDED}, CAST(v AS int) AS validation_rank FROM metrics JOIN (SELECT strategy, model_name, row_number() OVER (PARTITION BY strategy ORDER BY mae, model_name) AS v FROM metrics WHERE split_name = 'valid') USING (strategy, model_name)")
def _(spark, d):
    rows = metrics(spark, d)
    ranked = validation_ranked(rows, ["strategy"], "model_name", "mae").select("strategy", "model_name", F.col("rank").cast("int").alias("validation_rank"))
    return rounded(rows.join(ranked, ["strategy", "model_name"]), FIGURES)


@query("partition_counts", """SELECT n, CASE WHEN c3 = 0 THEN c1 - 1 ELSE c1 END AS train, c2 AS valid, CASE WHEN c3 = 0 THEN 1 ELSE c3 END AS test FROM (
  SELECT n, a + CAST(l > 0 AND r1 >= r2 AS int) AS c1, b + CAST(CASE WHEN r1 >= r2 THEN l > 1 ELSE l > 0 END AS int) AS c2, n - (a + CAST(l > 0 AND r1 >= r2 AS int)) - (b + CAST(CASE WHEN r1 >= r2 THEN l > 1 ELSE l > 0 END AS int)) AS c3
  FROM (SELECT n, n * 70 // 100 AS a, n * 15 // 100 AS b, n * 70 % 100 AS r1, n * 15 % 100 AS r2, n - n * 70 // 100 - 2 * (n * 15 // 100) AS l FROM (SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 3)))""")
def _(spark, d):
    sizes = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 3").select("n").distinct()
    return sizes.select("n", *(c.alias(s) for c, s in zip(P.partition_counts(F.col("n"), RATIOS), P.NAMES)))


@query("split_validate", "SELECT 'null keys' AS \"check\", 0 AS violations UNION ALL SELECT 'duplicate keys', 0 UNION ALL SELECT 'groups with several times', 0")
def _(spark, d):
    return P.validate_split_input(A.model_table(spark, d), A.KEYS, "group_id", "start_time")


@query("group_split", "SELECT group_id, line_no, split_name, fold FROM group_split")
def _(spark, d):
    return P.group_split(A.model_table(spark, d), "group_id", RATIOS, SEED).select(*A.KEYS, "split_name", "fold")


@query("forward_time_split", "SELECT group_id, line_no, split_name, fold FROM time_split")
def _(spark, d):
    return P.time_split(A.model_table(spark, d), "start_time", RATIOS).select(*A.KEYS, "split_name", "fold")


@query("split_assignment", "SELECT group_id, line_no, split_name, fold, 'forward' AS strategy FROM time_split")
def _(spark, d):
    return P.assignment(P.time_split(A.model_table(spark, d), "start_time", RATIOS), A.KEYS, "forward")


@query("split_audit", "SELECT c AS \"check\", CAST(CASE WHEN c = 'unknown rows' THEN (SELECT count(*) FROM time_split WHERE line_no = 1) WHEN c = 'unassigned rows' THEN (SELECT count(*) FROM model WHERE line_no = 2) ELSE 0 END AS bigint) AS violations FROM (VALUES ('unassigned rows'), ('unknown rows'), ('duplicate assignments'), ('empty splits'), ('shared instants'), ('order broken')) v(c)")
def _(spark, d):
    rows = A.model_table(spark, d).select(*A.KEYS, "start_time")
    split = P.time_split(rows, "start_time", RATIOS).filter("line_no <> 2")
    return P.audit_split(rows.filter("line_no <> 1"), split, A.KEYS, "start_time", A.line_tasks(spark, d))


@query("group_time_table", "SELECT group_id, min(start_time) AS start_time FROM model GROUP BY 1")
def _(spark, d):
    return P.group_times(A.model_table(spark, d), "group_id", "start_time")


FOLDS_VIEW = """folds AS (SELECT f.fold, t.group_id, CASE WHEN rk <= a THEN 'train' ELSE 'test' END AS part FROM (SELECT group_id, row_number() OVER (ORDER BY start_time, group_id) AS rk, count(*) OVER () AS n FROM (SELECT group_id, min(start_time) AS start_time FROM model GROUP BY 1)) t,
  (SELECT fold, CAST(round_even(c * (0.4::double + fold * 0.1::double), 0) AS bigint) AS a, CAST(round_even(c * (0.4::double + fold * 0.1::double + 0.1::double), 0) AS bigint) AS b FROM (VALUES (1), (2), (3), (4)) v(fold), (SELECT count(DISTINCT group_id) AS c FROM model)) f WHERE rk <= b)"""
SHARES = [0.4 + i * 0.1 for i in (1, 2, 3, 4)]


def folds(rows: DataFrame) -> DataFrame:
    return P.rolling_folds(P.group_times(rows, "group_id", "start_time"), "group_id", "start_time", SHARES, 0.1)


def fold_rows(spark, d) -> tuple[DataFrame, P.Windows]:
    """The model table, a row per row, with the segment of time that its group lies in, stored; and the windows that the segments make up."""
    rows = A.model_table(spark, d)
    segments, windows = P.fold_segments(P.group_times(rows, "group_id", "start_time"), "group_id", "start_time", SHARES, 0.1)
    return stored(rows.join(segments.hint("merge"), "group_id")), windows


@query("rolling_folds", f"WITH {FOLDS_VIEW} SELECT fold, part, count(*) AS n, sum(group_id)::bigint AS s FROM folds GROUP BY 1, 2")
def _(spark, d):
    return folds(A.model_table(spark, d)).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("group_id").alias("s"))


@query("holdout_split", "SELECT group_id, line_no, row_number() OVER (ORDER BY md5('42:' || group_id || ':' || line_no)) <= ceil(count(*) OVER () * 0.2) AS held FROM model")
def _(spark, d):
    return P.holdout_split(A.model_table(spark, d), A.KEYS, 0.2, SEED).select(*A.KEYS, "held")


@query("mean_model", "SELECT strategy, split_name, count(*) AS n, round(avg(predicted), 4) AS predicted FROM predictions WHERE model_name = 'mean' GROUP BY 1, 2")
def _(spark, d):
    fitted = R.mean_model(both_splits(spark, d, "group_id", "start_time", "label"), "label", by=["strategy"])
    return fitted.groupBy("strategy", "split_name").agg(F.count("*").alias("n"), F.round(F.avg("predicted"), 4).alias("predicted"))


# Ratings of a third of the items and codes of a fifth are taken away, so that there is something to fill.
PREPARED_SQL = "(SELECT group_id, line_no, split_name, CASE WHEN group_id % 3 <> 0 THEN points END AS points, CASE WHEN group_id % 4 <> 0 THEN popularity END AS popularity, CASE WHEN group_id % 5 <> 0 THEN index_letter ELSE '__missing__' END AS letter FROM joined WHERE strategy = 'forward')"


@query("preprocess_pipeline", f"""WITH r AS {PREPARED_SQL}, m AS (SELECT median(points) AS p, median(popularity) AS q FROM r WHERE split_name = 'train'),
  f AS (SELECT r.*, coalesce(points, p) AS x, coalesce(popularity, q) AS y FROM r, m), s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM f WHERE split_name = 'train'),
  k AS (SELECT letter, row_number() OVER (ORDER BY count(*) DESC, letter) AS hot FROM f WHERE split_name = 'train' GROUP BY 1)
  SELECT group_id, line_no, round((x - mx) / sx, 6) + 0.0::double AS points, round((y - my) / sy, 6) + 0.0::double AS popularity, coalesce(hot, 0) AS hot FROM f LEFT JOIN k USING (letter), s""")
def _(spark, d):
    kept = lambda c, k: F.when(F.col("group_id") % k != 0, F.col(c)).alias(c)
    rows = stored(forward_split(spark, d).select(*A.KEYS, "split_name", kept("points", 3), kept("popularity", 4), kept("index_letter", 5)))
    train = rows.filter("split_name = 'train'")
    made = R.preprocessor(train, ["points", "popularity", "index_letter"]).fit(train).transform(rows).select(*A.KEYS, vector_to_array("x").alias("x"))
    hot = F.array_position(F.slice("x", 3, 1000), F.lit(1.0)).alias("hot")
    return rounded(made.select(*A.KEYS, F.get("x", F.lit(0)).alias("points"), F.get("x", F.lit(1)).alias("popularity"), hot), {"points": 6, "popularity": 6})


SLOPE = "SELECT covar_pop(label, x) / (var_pop(x) + {alpha} * 1.0 / count(*) * var_pop(x)) AS w, avg(label) - avg(x) * covar_pop(label, x) / (var_pop(x) + {alpha} * 1.0 / count(*) * var_pop(x)) AS b FROM (SELECT label, CAST({x} AS double) AS x FROM joined WHERE strategy = 'forward' AND split_name IN {splits})"


@query("ridge", f"SELECT split_name, count(*) AS n, round(avg(abs(b + w * index_rank - label)), 4) AS mae FROM joined, ({SLOPE.format(alpha=1, x='index_rank', splits="('train')")}) WHERE strategy = 'forward' GROUP BY 1")
def _(spark, d):
    rows = forward_split(spark, d)
    fit = R.ridge(R.grams(rows, ["index_rank", "popularity"], "label", "split_name")["train"], ["index_rank"], 1.0)
    return rows.withColumn("e", F.abs(R.linear(*fit) - F.col("label"))).groupBy("split_name").agg(F.count("*").alias("n"), F.round(F.avg("e"), 4).alias("mae"))


def _tree(spark, d, name, estimator):
    rows = forward_split(spark, d)
    long = R.evaluate_grid(rows, [R.ModelSpec(name, ("index_rank", "popularity", "tag_count", "points"), estimator)], "label", A.KEYS)
    return M.regression_metrics(long, "actual", "predicted", ["model_name", "split_name"], BANDS)


@query("random_forest")
def _(spark, d):
    return _tree(spark, d, "random_forest", R.random_forest())


@query("gradient_boosting")
def _(spark, d):
    return _tree(spark, d, "gradient_boosting", R.gradient_boosting())


STUMP = (("index_rank", 0), ("tag_count", 1))


@query("boosted_stump", f"""WITH r AS (SELECT split_name, label, label - (SELECT avg(label) FROM joined WHERE strategy = 'forward' AND split_name = 'train') AS g, index_rank::double AS index_rank, tag_count::double AS tag_count FROM joined WHERE strategy = 'forward'),
  t AS ({' UNION ALL '.join(f"SELECT {i} AS f, {c} AS v, count(*) AS n, sum(g) AS g FROM r WHERE split_name = 'train' GROUP BY 2" for c, i in STUMP)}),
  c AS (SELECT f, v, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER (PARTITION BY f) AS n, sum(g) OVER (PARTITION BY f) AS g FROM t WINDOW w AS (PARTITION BY f ORDER BY v)),
  b AS (SELECT f, v, 0.06::double * lg / (ln + 0.01::double) AS low, 0.06::double * (g - lg) / (n - ln + 0.01::double) AS high FROM c WHERE ln >= 20 AND n - ln >= 20
        ORDER BY lg * lg / (ln + 0.01::double) + (g - lg) * (g - lg) / (n - ln + 0.01::double) DESC, f, v LIMIT 1)
  SELECT split_name, count(*) AS n, round(avg(abs(label - g + CASE WHEN CASE f WHEN 0 THEN index_rank ELSE tag_count END <= v THEN low ELSE high END - label)), 4) AS mae FROM r, b GROUP BY 1""")
def _(spark, d):
    """One step of boosting with one cut: the l2 term and the rate of `gradient_boosting`."""
    spec = R.ModelSpec("stump", tuple(c for c, _ in STUMP), R.gradient_boosting(1, depth=1))
    long = R.evaluate_grid(forward_split(spark, d), [spec], "label", A.KEYS)
    return M.regression_metrics(long, "actual", "predicted", ["split_name"], BANDS).select("split_name", "n", F.round("mae", 4).alias("mae"))


@query("evaluate_grid", " UNION ALL ".join(f"SELECT '{m}' AS model_name, split_name, count(*) AS n, round(avg(abs(b + w * {x} - label)), 4) AS mae FROM joined, ({SLOPE.format(alpha=0, x=x, splits="('train')")}) WHERE strategy = 'forward' GROUP BY 2" for m, x in (("rank", "index_rank"), ("popularity", "log_popularity"))))
def _(spark, d):
    specs = [R.ModelSpec("rank", ("index_rank",), R.least_squares()), R.ModelSpec("popularity", ("log_popularity",), R.least_squares())]
    long = R.evaluate_grid(forward_split(spark, d), specs, "label", A.KEYS)
    return M.regression_metrics(long, "actual", "predicted", ["model_name", "split_name"], BANDS).select("model_name", "split_name", "n", F.round("mae", 4).alias("mae"))


@query("evaluate_grid_metrics")
def _(spark, d):
    """Scores of forests over two feature sets."""
    specs = [R.ModelSpec("index_only", ("index_rank", "index_letter"), R.random_forest()), R.ModelSpec("all", ("index_rank", "index_letter", "popularity", "points"), R.random_forest())]
    long = R.evaluate_grid(forward_split(spark, d), specs, "label", A.KEYS)
    return M.regression_metrics(long, "actual", "predicted", ["model_name", "split_name"], BANDS)


TRY_SETS = {"rank": ["index_rank"], "popularity": ["popularity"]}
ALPHAS = [0.01, 1.0, 1000.0]
TRIES_SQL = " UNION ALL ".join(f"SELECT '{s}' AS feature_set, {a}::double AS alpha, avg(abs(b + w * {x} - label)) AS mae FROM joined, ({SLOPE.format(alpha=a, x=x, splits="('train')")}) WHERE strategy = 'forward' AND split_name = 'valid'" for s, (x,) in TRY_SETS.items() for a in ALPHAS)


@query("alpha_search", f"SELECT feature_set, alpha, round(mae, 4) AS mae FROM ({TRIES_SQL})")
def _(spark, d):
    rows = forward_split(spark, d)
    train = R.grams(rows, ["index_rank", "popularity"], "label", "split_name")["train"]
    return R.alpha_search(train, rows.filter("split_name = 'valid'"), TRY_SETS, ALPHAS, "label").select("feature_set", "alpha", F.round("mae", 4).alias("mae"))


REFIT_SQL = " UNION ALL ".join(f"SELECT group_id, line_no, '{s}' AS setting, label AS actual, b + w * {x} AS predicted FROM joined, ({SLOPE.format(alpha=1, x=x, splits="('train', 'valid')")}) WHERE strategy = 'forward' AND split_name = 'test'" for s, (x,) in TRY_SETS.items())


def refit(spark, d) -> DataFrame:
    """Test predictions of both settings, refitted on train and validation rows."""
    rows = forward_split(spark, d)
    g = R.grams(rows, ["index_rank", "popularity"], "label", "split_name")
    return R.predict_sets(rows.filter("split_name = 'test'"), g["train"] + g["valid"], TRY_SETS, {"rank": 1.0, "popularity": 1.0}, A.KEYS, "label")


@query("locked_refit", f"SELECT setting, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae FROM ({REFIT_SQL}) GROUP BY 1")
def _(spark, d):
    return refit(spark, d).groupBy("setting").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 4).alias("mae"))


FOLD_ERRORS = f"""{FOLDS_VIEW}, fold_rows AS (SELECT fold, part, m.* FROM model m JOIN folds USING (group_id)),
  fold_sums AS (SELECT fold, avg(label) AS my, avg(index_rank) AS m1, avg(log_popularity) AS m2, var_pop(index_rank) * (1 + 1.0::double / count(*)) AS a1, var_pop(log_popularity) * (1 + 1.0::double / count(*)) AS a2,
    covar_pop(index_rank, log_popularity) AS c2, covar_pop(label, index_rank) AS y1, covar_pop(label, log_popularity) AS y2 FROM fold_rows WHERE part = 'train' GROUP BY 1),
  fold_metrics AS (SELECT fold, feature_set, count(*) AS n, avg(abs(my + CASE feature_set WHEN 'mean' THEN 0 WHEN 'rank' THEN (index_rank - m1) * y1 / a1
      ELSE (index_rank - m1) * (y1 * a2 - y2 * c2) / (a1 * a2 - c2 * c2) + (log_popularity - m2) * (y2 * a1 - y1 * c2) / (a1 * a2 - c2 * c2) END - label)) AS mae
    FROM fold_rows JOIN fold_sums USING (fold), (VALUES ('mean'), ('rank'), ('full')) v(feature_set) WHERE part = 'test' GROUP BY 1, 2)"""
FOLD_SETS = {k: SETS[k] for k in ("mean", "rank", "full")}


def fold_metrics(rows: DataFrame, windows: P.Windows) -> DataFrame:
    """Scores per fold and feature set: a ridge model each, fitted on the fold's train rows. The sums of every segment, read once, add up to those
    of the nested training windows."""
    features = ["index_rank", "log_popularity"]
    sums = R.grams(rows, features, "label", "segment")
    models: dict[str, list] = {}
    for fold, _, _ in windows.bounds:
        train = reduce(lambda x, y: x + y, [sums[str(s)] for s in windows.of(fold, "train") if str(s) in sums])
        own = [((fold, name), *R.ridge(train, x, 1.0)) for name, x in FOLD_SETS.items()]
        for s in windows.of(fold, "test"):
            models.setdefault(str(s), []).extend(own)
    centre = float(next(iter(sums.values())).shift[-1])
    return R.linear_scores(rows, features, "label", "segment", models, ["fold", "feature_set"], BANDS, centre)


@query("rolling_evaluate", f"WITH {FOLD_ERRORS} SELECT fold, feature_set, n, round(mae, 4) AS mae FROM fold_metrics")
def _(spark, d):
    return fold_metrics(*fold_rows(spark, d)).select("fold", "feature_set", "n", F.round("mae", 4).alias("mae"))


@query("metrics_by_fold", f"WITH {FOLD_ERRORS} SELECT fold, feature_set, n, round(mae, 4) AS mae, first_test, last_train FROM fold_metrics JOIN (SELECT fold, min(start_time) FILTER (part = 'test') AS first_test, max(start_time) FILTER (part = 'train') AS last_train FROM fold_rows GROUP BY 1) USING (fold)")
def _(spark, d):
    rows, windows = fold_rows(spark, d)
    edges = rows.groupBy("segment").agg(F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    table = F.broadcast(spark.createDataFrame(windows.table(), "fold int, part string, segment int"))  # a few rows for each fold
    side = lambda p, c: F.when(F.col("part") == p, F.col(c))
    times = edges.join(table, "segment").groupBy("fold").agg(F.min(side("test", "first")).alias("first_test"), F.max(side("train", "last")).alias("last_train"))
    return fold_metrics(rows, windows).join(times.hint("broadcast"), "fold").select("fold", "feature_set", "n", F.round("mae", 4).alias("mae"), "first_test", "last_train")


@query("average_by_feature_set", f"WITH {FOLD_ERRORS} SELECT feature_set, round(avg(mae), 4) AS average, row_number() OVER (ORDER BY avg(mae), feature_set) = 1 AS best, (SELECT bool_and(a.mae > b.mae) FROM fold_metrics a JOIN fold_metrics b USING (fold) WHERE a.feature_set = 'mean' AND b.feature_set = 'rank') AS worse_in_every_fold FROM fold_metrics GROUP BY 1")
def _(spark, d):
    rows = stored(fold_metrics(*fold_rows(spark, d)))
    worse = M.consistently_worse(rows, "feature_set", "fold", "mae", "mean", "rank").first()[0]
    return rounded(M.average_metric(rows, "feature_set", "mae"), {"average": 4}).withColumn("worse_in_every_fold", F.lit(worse))


@query("drift_summary", f"""WITH {FOLDS_VIEW}, long AS (SELECT fold, part, 'popularity' AS feature, popularity::double AS v FROM model JOIN folds USING (group_id) UNION ALL SELECT fold, part, 'label', label FROM model JOIN folds USING (group_id)),
  s AS (SELECT fold, feature, avg(v) FILTER (part = 'train') AS m1, avg(v) FILTER (part = 'test') AS m2, quantile_cont(v, 0.5) FILTER (part = 'train') AS d1, quantile_cont(v, 0.5) FILTER (part = 'test') AS d2, quantile_cont(v, 0.9) FILTER (part = 'train') AS p1, quantile_cont(v, 0.9) FILTER (part = 'test') AS p2, var_pop(v) FILTER (part = 'train') AS v1, var_pop(v) FILTER (part = 'test') AS v2 FROM long GROUP BY 1, 2)
  SELECT fold, feature, round(m1, 4) AS train_mean, round(m2, 4) AS test_mean, round(d2 - d1, 4) AS median_diff, round(p2 - p1, 4) AS p90_diff, round((m2 - m1) / sqrt((v1 + v2) / 2), 6) AS smd FROM s""")
def _(spark, d):
    rows, windows = fold_rows(spark, d)
    out = M.drift_by_fold(rows, ["popularity", "label"], "segment", windows.table())
    return out.select("fold", "feature", *(F.round(c, 4).alias(c) for c in ("train_mean", "test_mean", "median_diff", "p90_diff")), F.round("smd", 6).alias("smd"))


#: groups of features that the ablation leaves out one at a time, and the sets that it compares
GROUPS = {"index": ["index_rank", "index_number", "index_letter"], "solved": ["log_popularity", "popularity_missing"], "points": ["points", "has_points"], "tags": ["tags"]}
ABLATION = {**{g: (g,) for g in GROUPS}, "all": tuple(GROUPS), **{f"all_without_{g}": tuple(x for x in GROUPS if x != g) for g in GROUPS}}


#: the numbers among the features; they come first and grow together
HEAD = 6
#: columns up to which models are solved from their products, one pass in all
DIRECT = 512


def ablation_rows(rows: DataFrame) -> tuple[DataFrame, dict[str, list[tuple[int, int]]], int]:
    """(keys, label and split with sparse features, the places of every feature group, how many places): numbers scaled and texts one-hot by the train rows, and
    one place for every tag that a train row has."""
    train = rows.filter("split_name = 'train'")
    plain = [c for g in GROUPS.values() for c in g if c != "tags"]
    e = fit_encoding(train, plain)
    words = array_dictionary(train, "tags")
    n_tags = words.count()
    coded = encoded(rows.select(*A.KEYS, "label", "split_name", *plain), e)
    # the tags of a row come after its other places
    tags = encode_array(rows, A.KEYS, "tags", words).withColumn("places", F.transform("places", lambda p: p + e.size))
    coded = coded.join(tags.hint("merge"), A.KEYS).select(*A.KEYS, "label", "split_name", F.concat("indices", "places").alias("indices"), F.concat("values", F.transform("places", lambda _: F.lit(1.0))).alias("values"))
    places = {g: [(e.size, e.size + n_tags)] if g == "tags" else [e.ranges[c] for c in cols] for g, cols in GROUPS.items()}
    return stored(coded, "ablation"), places, e.size + n_tags


def both_strategies(spark, d) -> list[tuple[str, DataFrame]]:
    rows = A.model_table(spark, d)
    return [("forward", stored(P.time_split(rows, "start_time", RATIOS))), ("grouped", stored(P.group_split(rows, "group_id", RATIOS, SEED)))]


def ablation_scores(scored: list[DataFrame]) -> DataFrame:
    """Metrics of every set by strategy and split, ranked by the validation error within a strategy, and how much more the set errs than all features do."""
    rows = stored(M.regression_metrics(union(scored), "label", "predicted", ["strategy", "setting", "split_name"], BANDS).withColumnRenamed("setting", "feature_set"))
    ranked = validation_ranked(rows, ["strategy"], "feature_set", "mae").select("strategy", "feature_set", F.col("rank").cast("int").alias("validation_rank"))
    every = rows.filter("feature_set = 'all'").select("strategy", "split_name", F.col("mae").alias("_all"))
    rows = rows.join(ranked.hint("broadcast"), ["strategy", "feature_set"]).join(every.hint("broadcast"), ["strategy", "split_name"])
    return rounded(rows.withColumn("mae_over_all", F.col("mae") - F.col("_all")).drop("_all"), FIGURES | {"mae_over_all": 4})


@query("ablation_sets")
def _(spark, d):
    """Ridge models over nine sets of feature groups, tags among them, by strategy and split, ranked by their validation error. All sets of a strategy are solved in
    shared passes over its sparse rows."""
    scored = []
    for strategy, rows in both_strategies(spark, d):
        coded, places, size = ablation_rows(rows)
        sets = {s: [r for g in groups for r in places[g]] for s, groups in ABLATION.items()}
        train = coded.filter("split_name = 'train'")
        models = gram_ridge(train, size, "label", sets, 1.0) if size <= DIRECT else sparse_ridge(train, size, "label", sets, 1.0, head=HEAD)
        scored.append(predict_sparse(coded, models, ["split_name", "label"]).withColumn("strategy", F.lit(strategy)))
    return ablation_scores(scored)


#: tags that trees see one by one, the most frequent ones; of the others they see the number
TREE_TAGS = 32


def tree_rows(rows: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rows with a number for every feature, stored; the columns of every feature group), learned from the train rows."""
    train = rows.filter("split_name = 'train'")
    tags: list = array_dictionary(train, "tags").filter(F.col("place") < TREE_TAGS).orderBy("place").collect()
    flags = {f"_tag{r.place}": F.array_contains("tags", r.term).cast("double") for r in tags}
    numbers = {g: [c for c in own if dict(rows.dtypes)[c] != "string" and c != "tags"] for g, own in GROUPS.items()}
    ready, letters = T.tree_columns(train, rows, ["index_letter"])
    groups = numbers | {"index": [*numbers["index"], *letters], "tags": ["tag_count", *flags]}
    used = [c for g in groups.values() for c in g]
    ready = ready.withColumns(flags).select("split_name", "label", *(F.col(c).cast("double").alias(c) for c in used))
    return stored(ready, "ablation"), groups


@query("ablation_boosting")
def _(spark, d):
    """The same sets with boosted trees, grown together over one table of bins for each strategy."""
    cfg = R.gradient_boosting()("x", "label")
    rows = stored(_two_splits(spark, d, "group_id", "start_time", "label", "tag_count", *(c for g in GROUPS.values() for c in g), table=A.model_table))

    def scored(strategy: str) -> DataFrame:
        ready, groups = tree_rows(rows.withColumn("split_name", F.col(f"_{strategy}")["split_name"]))
        sets = {s: [c for g in own for c in groups[g]] for s, own in ABLATION.items()}
        models = T.fit_boosted(ready.filter("split_name = 'train'"), sets, "label", cfg)
        return T.predict_sets(ready, models, ["split_name", "label"]).withColumn("strategy", F.lit(strategy))

    # at the same time, as few tasks are long while models grow
    with ThreadPoolExecutor(2) as pool:
        return ablation_scores(list(pool.map(scored, ("forward", "grouped"))))


@query("residual_interval", """WITH r AS (SELECT abs(predicted - actual) AS a FROM predictions WHERE strategy = 'forward' AND model_name = 'rank' AND split_name = 'valid')
  SELECT round(avg(a), 4) AS mean_residual, round(quantile_cont(a, 0.8), 4) AS half_width, false AS fallback FROM r""")
def _(spark, d):
    rows = predictions(spark, d).filter("strategy = 'forward' and model_name = 'rank' and split_name = 'valid'")
    return rounded(residual_interval(rows, "actual", "predicted"), {"mean_residual": 4, "half_width": 4})


SCENARIOS = {"reference": ["index_rank", "log_popularity"], "cold_start": ["index_rank", "tag_count"]}


def _scenario_sql(name: str, x: str, z: str) -> str:
    """Errors of a ridge model with two features over the items that took no part in its fit."""
    sums = f"SELECT avg(label) AS my, avg({x}) AS m1, avg({z}) AS m2, var_pop({x}) * (1 + 1.0::double / count(*)) AS a1, var_pop({z}) * (1 + 1.0::double / count(*)) AS a2, covar_pop({x}, {z}) AS c, covar_pop(label, {x}) AS y1, covar_pop(label, {z}) AS y2 FROM model WHERE line_no <> 6"
    return f"SELECT '{name}' AS scenario, count(*) AS n, round(avg(abs(my + ({x} - m1) * (y1 * a2 - y2 * c) / (a1 * a2 - c * c) + ({z} - m2) * (y2 * a1 - y1 * c) / (a1 * a2 - c * c) - label)), 4) AS mae FROM model, ({sums}) WHERE line_no = 6"


@query("scenario_scoring", " UNION ALL ".join(_scenario_sql(k, *v) for k, v in SCENARIOS.items()))
def _(spark, d):
    rows = A.model_table(spark, d)
    scored = score_scenarios(rows, rows.filter("line_no = 6"), SCENARIOS)
    return scored.groupBy("scenario").agg(F.count("predicted").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 4).alias("mae"))


def score_scenarios(rows: DataFrame, items: DataFrame, scenarios: dict[str, list[str]], alpha: float = 1.0) -> DataFrame:
    """(keys..., scenario, actual, predicted) of many items at once, none of them in the training rows. One pass of sums serves all scenarios."""
    train = J.exclude(rows, items.select(*A.KEYS), A.KEYS).withColumn("part", F.lit("train"))
    every = sorted({c for s in scenarios.values() for c in s})
    g = R.grams(train, every, "label", "part")["train"]
    return R.predict_sets(items, g, scenarios, dict.fromkeys(scenarios, alpha), A.KEYS, "label").withColumnRenamed("setting", "scenario")
