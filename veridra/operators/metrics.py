"""Aggregates: errors, profiles, coverage, correlation, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.operators.ranks import quantiles_by, with_quantiles
from veridra.sources.workspace import stored


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str], bands: tuple[float, float] = (100, 200)) -> DataFrame:
    """(by..., n, mae, rmse, r2, within_1, within_2) in one pass; r2 is null below two rows or for a constant label."""
    e = F.col(yhat) - F.col(y)
    near = [F.avg((F.abs(e) <= b).cast("int")).alias(f"within_{i + 1}") for i, b in enumerate(bands)]
    rows = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count("*")).alias("_sst"), *near)
    r2 = F.when((F.col("n") > 1) & (F.col("_sst") > 0), 1 - F.col("_sse") / F.col("_sst"))
    return rows.select(*by, "n", "mae", "rmse", r2.alias("r2"), "within_1", "within_2")


def error_by(df: DataFrame, by: list[str], min_count: int = 1, error: str = "absolute_error") -> DataFrame:
    """(by..., n, mean_error) of groups with enough rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(error).alias("mean_error")).filter(F.col("n") >= min_count)


def error_by_array(df: DataFrame, col: str, by: list[str], min_count: int = 30, error: str = "absolute_error") -> DataFrame:
    """The same per term of an array column."""
    return error_by(df.select(*by, error, F.explode(F.array_distinct(col)).alias("term")), [*by, "term"], min_count, error)


def array_frequency(df: DataFrame, col: str) -> DataFrame:
    """(term, n, share of all rows)."""
    total = df.count()
    terms = df.select(F.explode(F.array_distinct(col)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.withColumn("share", F.col("n") / F.lit(float(max(total, 1))))


def group_profile(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """(by..., n, share, mean, median) of the label."""
    df = stored(df.select(*by, y))
    rows = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("mean")).withColumn("share", F.col("n") / F.lit(float(max(df.count(), 1))))
    return with_quantiles(rows, df, by, y, {"median": 0.5})


def banded_profile(df: DataFrame, col: str, width: int, popularity: str, tags: str) -> DataFrame:
    """(band, label, low, high, n, share, median_popularity, mean_tags) of left-closed bands."""
    df = stored(df.select((F.floor(F.col(col) / width) * width).cast("long").alias("band"), F.col(col).alias("value"), F.col(popularity).alias("popularity"), F.col(tags).alias("tags")))
    rows = df.groupBy("band").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.avg("tags").alias("mean_tags"))
    rows = rows.withColumn("share", F.col("n") / F.lit(float(max(df.count(), 1)))).withColumn("label", F.concat(F.col("band").cast("string"), F.lit("-"), (F.col("band") + width - 1).cast("string")))
    return with_quantiles(rows, df, ["band"], "popularity", {"median_popularity": 0.5})


def quantiles(df: DataFrame, col: str, qs: list[float], approximate: int | None = None) -> DataFrame:
    """(q, value): exact with linear interpolation, or approximate with the given accuracy."""
    if approximate:
        found = df.agg(F.percentile_approx(col, qs, approximate).alias("v"))
    else:
        names = {f"q{i}": q for i, q in enumerate(qs)}
        found = quantiles_by(stored(df.select(col)), [], col, names).select(F.array(*names).alias("v"))
    return found.select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"), "value")


def describe_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, n, mean, median, p75, p90, p95, p99, max)."""
    long = stored(df.select(*(F.col(c).cast("double").alias(c) for c in cols)).unpivot([], cols, "feature", "value").dropna(subset=["value"]))
    rows = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return with_quantiles(rows, long, ["feature"], "value", {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def split_sizes(split: DataFrame, group: str, by: list[str]) -> DataFrame:
    return split.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"))


def group_overlap(split: DataFrame, group: str, by: list[str]) -> DataFrame:
    """(by..., group, n_splits) of groups in more than one split."""
    return split.groupBy(*by, group).agg(F.count_distinct("split_name").alias("n_splits")).filter("n_splits > 1")


def split_ranges(df: DataFrame, time: str) -> DataFrame:
    """(split_name, first, last, strict_order): whether every split ends before the next begins."""
    rows = df.groupBy("split_name").agg(F.min(time).alias("first"), F.max(time).alias("last"))
    at = lambda s, c: F.max(F.when(F.col("split_name") == s, F.col(c))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  three rows
    return rows.withColumn("strict_order", (at("train", "last") < at("valid", "first")) & (at("valid", "last") < at("test", "first")))


def correlations(df: DataFrame, y: str, xs: list[str], by: str) -> DataFrame:
    """(scope, signal, n, correlation): overall and per bucket in one pass over grouping sets; null below two rows."""
    long = df.select(by, y, *(F.col(x).cast("double").alias(x) for x in xs)).unpivot([by, y], xs, "signal", "value")
    rows = long.groupingSets([["signal"], ["signal", by]], "signal", by).agg(F.count("*").alias("n"), F.corr(y, "value").alias("c"), F.grouping(by).alias("g"))
    return rows.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(by)).alias("scope"), "signal", "n", F.when((F.col("n") > 1) & ~F.isnan("c"), F.col("c")).alias("correlation"))


def drift(df: DataFrame, cols: list[str], part: str, by: list[str]) -> DataFrame:
    """(by..., feature, train_*, test_*, differences, smd): standardised by the mean of the population variances; null if that is 0."""
    long = stored(df.select(*by, part, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot([*by, part], cols, "feature", "value"))
    keys = [*by, "feature", part]
    rows = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return _drift(with_quantiles(rows, long, keys, "value", {"median": 0.5, "p90": 0.9}), part, by)


def _drift(rows: DataFrame, part: str, by: list[str]) -> DataFrame:
    """Train and test facts of each feature side by side."""
    side = lambda s, m: F.max(F.when(F.col(part) == s, F.col(m))).alias(f"{s}_{m}")
    rows = rows.groupBy(*by, "feature").agg(*(side(s, m) for s in ("train", "test") for m in ("mean", "median", "p90", "var")))
    sd = F.sqrt((F.col("train_var") + F.col("test_var")) / 2)
    diff = {f"{m}_diff": F.col(f"test_{m}") - F.col(f"train_{m}") for m in ("mean", "median", "p90")}
    return rows.withColumns(diff).withColumn("smd", F.when(sd > 0, F.col("mean_diff") / sd)).drop("train_var", "test_var")


def drift_by_fold(df: DataFrame, cols: list[str], segment: str, windows: list[tuple[int, str, int]]) -> DataFrame:
    """The same per fold (fold, feature, ...), whose windows are runs of segments: `windows` lists (fold, part, segment). Segments are summed and
    counted once and merged to windows, so a row that lies in many training windows is read as often as any other. `df` is read once
    for the sums and a few times for the quantiles; give it stored."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(windows, "fold int, part string, segment int"))  # a few rows for each fold
    long = df.select(F.col(segment).alias("segment"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols))).alias("_x")).select("segment", "_x.*")
    sums = long.groupBy("segment", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    # the variance of a union: within its parts, and of their means
    rows = sums.filter("n > 0").join(table, "segment").groupBy("fold", "feature", "part").agg(mean.alias("mean"), (F.sum(F.col("n") * F.col("v")) / total).alias("within"), F.collect_list(F.struct("n", "m")).alias("parts"))
    spread = F.aggregate("parts", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, x: F.struct((a["s"] + x["n"] * (x["m"] - F.col("mean")) * (x["m"] - F.col("mean"))).alias("s"), (a["n"] + x["n"]).alias("n")), lambda a: a["s"] / a["n"])
    rows = rows.withColumn("var", F.col("within") + spread)
    into = {s: F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(p).alias("part")) for f, p, x in windows if x == s)) for s in sorted({s for _, _, s in windows})}

    def targets(part: Column) -> Column:
        own = F.lit(None).cast("array<struct<fold: int, part: string>>")
        for s, of in into.items():
            own = F.when(part["segment"] == s, of).otherwise(own)
        return F.transform(own, lambda t: F.struct(t["fold"].alias("fold"), part["feature"].alias("feature"), t["part"].alias("part")))

    found = quantiles_by(long, ["segment", "feature"], "value", {"median": 0.5, "p90": 0.9}, into=(["fold", "feature", "part"], targets))
    return _drift(rows.join(found.drop("_k", "n").hint("merge"), ["fold", "feature", "part"]), "part", ["fold"])


def coverage(df: DataFrame, split: str, group: str, time: str, parsed: str) -> DataFrame:
    """(split, n, n_groups, n_times, parsed, coverage) per split and over all."""
    rows = df.rollup(split).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.count_distinct(time).alias("n_times"), F.count_if(F.col(parsed)).alias("parsed"))
    return rows.withColumn(split, F.coalesce(split, F.lit("overall"))).withColumn("coverage", F.col("parsed") / F.col("n"))


def counts_filled(df: DataFrame, col: str, labels: list[str]) -> DataFrame:
    """(label, n, position) over all labels, 0 where none occurs."""
    known = df.sparkSession.createDataFrame(list(enumerate(labels)), "position int, label string")
    counts = df.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n"))
    return known.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def average_metric(df: DataFrame, by: str, metric: str) -> DataFrame:
    """(by, average, best): mean over folds, the lowest marked (ties by name)."""
    rows = df.groupBy(by).agg(F.avg(metric).alias("average"))
    return rows.withColumn("best", F.row_number().over(Window.orderBy("average", by)) == 1)  # one row per set


def consistently_worse(df: DataFrame, by: str, fold: str, metric: str, a: str, b: str) -> DataFrame:
    """One row: whether a's metric is above b's in every fold."""
    wide = df.groupBy(fold).pivot(by, [a, b]).agg(F.first(metric))
    return wide.agg(F.coalesce(F.bool_and(F.col(f"`{a}`") > F.col(f"`{b}`")), F.lit(False)).alias("worse_in_every_fold"))


def gap_summary(metrics: DataFrame, by: list[str], metric: str = "mae", floor: float = 50, share: float = 0.2) -> DataFrame:
    """(by..., train, valid, test, gap, ratio, flagged): test minus train, flagged above the larger of floor and share of train."""
    wide = metrics.groupBy(*by).pivot("split_name", ["train", "valid", "test"]).agg(F.first(metric))
    gap = F.col("test") - F.col("train")
    return wide.withColumn("gap", gap).withColumn("ratio", F.when(F.col("train") != 0, F.col("test") / F.col("train"))).withColumn("flagged", gap > F.greatest(F.lit(float(floor)), share * F.col("train")))


def gap_category(gaps: DataFrame, strategy: str = "strategy", model: str = "model_name", baselines: tuple[str, ...] = ()) -> DataFrame:
    """Why a flagged gap may be there: a baseline has no capacity, a forward split shifts, anything else overfits."""
    kind = F.when(~F.col("flagged"), "none").when(F.col(model).isin(*baselines), "baseline").when(F.col(strategy) == "forward", "temporal").otherwise("overfitting")
    return gaps.withColumn("category", kind)


def data_dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, has_nulls), one aggregate per table."""
    parts = []
    for name, df in tables.items():
        row = df.agg(*(F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in df.columns))
        long = row.unpivot([], df.columns, "column", "has_nulls")
        kinds = F.create_map(*[F.lit(x) for ct in df.dtypes for x in ct])
        parts.append(long.select(F.lit(name).alias("table"), "column", F.element_at(kinds, F.col("column")).alias("type"), "has_nulls"))
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, col: str, bins: int, transform: str | None = None, clip: float | None = None) -> tuple[DataFrame, float | None]:
    """(bin, low, n) of equal-width bins over non-null values, optionally log1p of the non-negative ones or clipped at a quantile, and the threshold."""
    v = F.col(col).cast("double")
    values = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    limit = None
    if transform == "log1p":
        values = values.filter("v >= 0").select(F.log1p("v").alias("v"))
    if clip is not None:
        values = stored(values)
        found = quantiles_by(values, [], "v", {"limit": clip}).first()
        limit = found and found.limit
        values = values.select(F.least("v", F.lit(limit)).alias("v"))
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return values.select(F.lit(0).alias("bin"), F.col("v").alias("low"), F.lit(0).alias("n")).limit(0), limit
    width = (hi - lo) / bins or 1.0
    i = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("long")
    return values.groupBy(i.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", lo + F.col("bin") * width), limit


def box_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by..., n, min, q1, median, q3, max)."""
    df = stored(df.select(*by, col))
    rows = df.groupBy(*by).agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"))
    return with_quantiles(rows, df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def manifest_summary(manifest: DataFrame, kinds: list[str]) -> DataFrame:
    """One row: entries, bytes, a count per kind with zeros, and a digest of all entries, whatever their order.

    The digest is the root of a tree: entries are digested in groups by their own hash's first digits, groups in groups of 256 by fewer
    digits, so that no task gathers more than some hundred of them."""
    line = F.concat_ws("\t", "relative_path", "sha256", F.col("size_bytes").cast("string"), "kind")
    totals = manifest.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    digits, n = 0, manifest.count()
    while n > 256 ** (digits // 2 + 1):
        digits += 2
    level = manifest.select(F.sha2(line, 256).alias("d")).withColumn("at", F.col("d"))
    for k in range(digits, -1, -2):
        level = level.groupBy(F.substring("at", 1, k).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    return totals.withColumn("digest", F.lit((level.first() or [None, None])[1]))


def word_count(col: Column) -> Column:
    """Words plus CJK characters, code and links taken out."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?s)```.*?```|`[^`]*`", " ")
    text = F.regexp_replace(text, r"https?://\S+", " ")
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*")) + F.regexp_count(text, F.lit(r"[一-鿿]"))
