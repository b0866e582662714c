"""Joins with declared cardinality: what does not hold fails, what does not match is counted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridra.operators.checks import assert_unique, fail_if
from veridra.operators.normalize import norm_key


def left_join(left: DataFrame, right: DataFrame, on: list[str], prefix: str = "", suffix: str = "_right", validate: str = "m:1") -> DataFrame:
    """Left join on keys. The right side must be unique, with 1:1 the left too. Right columns that collide get the suffix, or all the prefix;
    with a prefix a collision is an error."""
    assert_unique(right, on, "right side")
    if validate == "1:1":
        assert_unique(left, on, "left side")
    names = {c: (prefix + c if prefix else c + suffix if c in left.columns else c) for c in right.columns if c not in on}
    if prefix and set(names.values()) & set(left.columns):
        raise ValueError("prefixed columns collide")
    return left.join(right.select(*on, *(F.col(c).alias(n) for c, n in names.items())), on, "left")


def column_sources(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str] = ("left", "right")) -> dict[str, str]:
    """Result column -> side it comes from."""
    return {c: names[0] for c in left.columns} | {(c if c not in left.columns else c + "_right"): names[1] for c in right.columns if c not in on}


def join_split(df: DataFrame, split: DataFrame, keys: list[str], how: str = "inner", names: Iterable[str] = ("train", "valid", "test"), normalize: bool = False) -> DataFrame:
    """Rows with their split. Every row must have one and no part may be empty (one pass over the result's counts)."""
    if normalize:
        df, split = (x.withColumns({k: norm_key(F.col(k)) for k in keys}) for x in (df, split))
    assert_unique(split, keys, "split")
    if how == "left":
        joined = df.join(split, keys, "left")
        return fail_if(joined, F.col("split_name").isNull(), "row without split")
    joined = df.join(split, keys)
    counts = {r.split_name: r["count"] for r in joined.groupBy("split_name").count().collect()}
    if sum(counts.values()) != df.count() or set(counts) != set(names):
        raise ValueError(f"incomplete split: {counts}")
    return joined


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in a declared order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def enrich(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Left join of the right side's first rows per normalised key, and one row of counts: matched and unmatched of both sides."""
    clean = lambda x: x.withColumns({k: norm_key(F.col(k)) for k in keys})
    left, right = clean(left), dedupe(clean(right), keys, order)
    picked = right.select(*keys, *(columns if columns is not None else [c for c in right.columns if c not in left.columns]))
    a, b = left.select(*keys).withColumn("_l", F.lit(1)), right.select(*keys).withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full")
    counts = both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched_left"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNull()).alias("unmatched_left"),
        F.count_if(F.col("_l").isNull() & F.col("_r").isNotNull()).alias("unmatched_right"),
    )
    return left.join(picked, keys, "left"), counts


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right keys without a left row."""
    return right.select(*keys).distinct().join(left, keys, "left_anti")


def exclude(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return df.join(known, keys, "left_anti")


def keep_selected(metrics: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """Metric rows of the selected candidates."""
    return metrics.join(selected, on, "left_semi")


def enrich_predictions(predictions: DataFrame, features: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Predictions with item features, error (predicted - actual) and absolute error."""
    joined = predictions.join(assert_unique(features, keys, "features"), keys, "left")
    return joined.withColumn("error", F.col(predicted) - F.col(actual)).withColumn("absolute_error", F.abs("error"))


def source_column(primary: DataFrame, secondary: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys..., column): from the primary if it has the column, else looked up in the secondary."""
    if column in primary.columns:
        return primary.select(*keys, column)
    return primary.select(*keys).join(assert_unique(secondary.select(*keys, column), keys), keys, "left")


def assert_equal(left: DataFrame, right: DataFrame, on: list[str], column: str) -> DataFrame:
    """Keys whose values differ between the two, nulls equal."""
    return left.select(*on, F.col(column).alias("x")).join(right.select(*on, F.col(column).alias("y")), on).filter(~F.col("x").eqNullSafe(F.col("y"))).select(*on, "x", "y")


def variant_join(items: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Items with the page whose key matches best: exact, upper, lower, then any case; ties by the page's key. Items without one stay."""
    p = pages.withColumnRenamed(key, "page_key").withColumn("_k", F.lower("page_key"))
    i = items.withColumn("_k", F.lower(key))
    rank = F.when(F.col("page_key") == F.col(key), 1).when(F.col("page_key") == F.upper(key), 2).when(F.col("page_key") == F.lower(key), 3).otherwise(4)
    keys = [c for c in items.columns]
    return i.join(p, "_k", "left").withColumn("match", F.when(F.col("page_key").isNotNull(), rank)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("match", "page_key"))).filter("_n = 1").drop("_n", "_k")
