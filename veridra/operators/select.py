"""Choosing by validation, reporting on test; rankings, comparisons, resampling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.operators.checks import assert_finite, assert_unique
from veridra.operators.draws import POISSON, draws, halves  # noqa: F401  (the oracle of the bootstrap names the limits)
from veridra.operators.ranks import quantiles_by
from veridra.sources.workspace import stored


def check_metrics(metrics: DataFrame, group: list[str], candidate: str, metric: str) -> DataFrame:
    """The frame; an error for duplicates, values that are not finite, or candidates that only one of valid and test has."""
    rows = metrics.filter(F.col("split_name").isin("valid", "test"))
    keys = [*group, candidate, "split_name"]
    assert_finite(assert_unique(rows, keys, "metrics"), [metric], keys)
    odd = rows.groupBy(*group, candidate).agg(F.count_distinct("split_name").alias("n")).filter("n < 2").limit(1).count()
    if odd:
        raise ValueError("valid and test have other candidates")
    return metrics


def validation_ranked(metrics: DataFrame, group: list[str], candidate: str, metric: str) -> DataFrame:
    """(group..., candidate, valid_<metric>, test_<metric>, rank): ranked within the group by validation, ties by name; test is only attached."""
    check_metrics(metrics, group, candidate, metric)
    rows = metrics.groupBy(*group, candidate).agg(*(F.max(F.when(F.col("split_name") == s, F.col(metric))).alias(f"{s}_{metric}") for s in ("valid", "test")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(f"valid_{metric}", candidate)))


def select_best(ranked: DataFrame) -> DataFrame:
    """Rank one of every group; an error if there is none."""
    best = ranked.filter("rank = 1")
    if best.isEmpty():
        raise ValueError("nothing to select")
    return best


def best_by(df: DataFrame, by: list[str], metric: str, ties: list[str], where: Column | None = None, k: int = 1) -> DataFrame:
    """The k lowest rows of every group (of those that `where` keeps), ties by the listed columns, with `rank`."""
    rows = df if where is None else df.filter(where)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(metric, *ties))).filter(F.col("rank") <= k)


def locked_report(metrics: DataFrame, group: list[str], setting: str, candidate: str, metric: str, reference: str) -> DataFrame:
    """All settings' rows of the candidate that wins on the reference setting by validation: chosen once, held for all."""
    chosen = select_best(validation_ranked(metrics.filter(F.col(setting) == reference), group, candidate, metric)).select(*group, candidate)
    return metrics.join(chosen, [*group, candidate], "left_semi")


def top_errors(df: DataFrame, n: int, by: list[str], ties: list[str], error: str = "absolute_error", rank: str = "error_rank") -> DataFrame:
    """The n largest errors (of every group), ties by key, numbered."""
    if by:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(error), *ties))).filter(F.col(rank) <= n)
    few = df.orderBy(F.desc(error), *ties).limit(n)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(error), *ties)))  # n rows


def argmax_group(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """(by..., name, value, note): the largest value's row, ties by name; noted where it is not positive."""
    top = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), name))).filter("_n = 1")
    return top.select(*by, name, value, F.when(F.col(value) <= 0, "no harmful removal").otherwise("").alias("note"))


def mismatch(df: DataFrame, y: str, x: str, q: float, k: int, keys: list[str]) -> DataFrame:
    """(quadrant, rank, keys..., y, x): rows that are extreme in both, k per quadrant, the most extreme x first, then y, then key."""
    df = stored(df.select(*keys, y, x))
    cuts = {c: quantiles_by(df, [], c, {"lo": 1 - q, "hi": q}).first() for c in (y, x)}  # four numbers
    if None in cuts.values():
        return df.limit(0).select(F.lit("").alias("quadrant"), F.lit(0).alias("rank"), *keys, y, x)
    (ylo, yhi), (xlo, xhi) = ((cuts[c].lo, cuts[c].hi) for c in (y, x))
    side = lambda c, lo, hi: F.when(F.col(c) >= hi, "high").when(F.col(c) <= lo, "low")
    rows = df.withColumn("_y", side(y, ylo, yhi)).withColumn("_x", side(x, xlo, xhi)).filter("_y is not null and _x is not null")
    sign = lambda s: F.when(F.col(s) == "high", -1.0).otherwise(1.0)
    rows = rows.withColumn("quadrant", F.concat(F.lit("label_"), "_y", F.lit("_rate_"), "_x"))
    order = [sign("_x") * F.col(x), sign("_y") * F.col(y), *keys]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("quadrant").orderBy(*order))).filter(F.col("rank") <= k).select("quadrant", "rank", *keys, y, x)


def improvement(metrics: DataFrame, by: list[str], setting: str, metric: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(by..., baseline, comparison, baseline_value, comparison_value, change, percent) of listed pairs; positive is better (lower)."""
    listed = metrics.sparkSession.createDataFrame(pairs, "baseline string, comparison string")
    side = lambda n: metrics.select(*by, F.col(setting).alias(n), F.col(metric).alias(f"{n}_value"))
    rows = F.broadcast(listed).join(side("baseline"), "baseline").join(side("comparison"), [*by, "comparison"])
    change = F.col("baseline_value") - F.col("comparison_value")
    return rows.select(*by, "baseline", "comparison", "baseline_value", "comparison_value", change.alias("change"), F.when(F.col("baseline_value") != 0, 100 * change / F.col("baseline_value")).alias("percent"))


def versus_reference(metrics: DataFrame, by: list[str], setting: str, metric: str, reference: str, others: list[str] | None = None) -> DataFrame:
    """(by..., setting, value, reference_value, gap): every (listed) setting against one."""
    ref = metrics.filter(F.col(setting) == reference).select(*by, F.col(metric).alias("reference_value"))
    rows = metrics.filter(F.col(setting) != reference)
    if others is not None:
        rows = rows.filter(F.col(setting).isin(*others))
    return rows.join(ref, by).select(*by, setting, F.col(metric).alias("value"), "reference_value", (F.col(metric) - F.col("reference_value")).alias("gap"))


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, setting: str, error: str, pair: tuple[str, str], reps: int, seed: int, level: float = 0.95) -> DataFrame:
    """One row (estimate, low, high, clusters, reps): percentile interval of the difference of two settings' mean errors, whole clusters
    drawn with replacement. Rows that lack one of the settings are an error.

    Each replicate draws each cluster a Poisson number of times, mean 1: the form of the bootstrap in which clusters are drawn independently, so that
    no task has to know the others' clusters. The number is a hash of seed, replicate and the cluster's md5, so any engine repeats it. A task
    holds its clusters' sums in Arrow batches, draws them for some replicates at a time, multiplies, and emits one row of sums per replicate; the
    interval is read off `reps` numbers.
    """
    a, b = (F.sum(F.when(F.col(setting) == s, F.col(error))) for s in pair)
    counts = df.filter(F.col(setting).isin(*pair)).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(setting).alias("s"))
    if counts.filter("n <> 2 or s <> 2").limit(1).count():
        raise ValueError("rows are not paired")
    sums = df.groupBy(cluster).agg(a.alias("a"), b.alias("b"), F.count_if(F.col(setting) == pair[0]).cast("double").alias("n"))
    high, low = halves(F.col(cluster))
    sums = stored(sums.select(high.alias("high"), low.alias("low"), "a", "b", "n"), "clusters")
    total_a, total_b, total, clusters = sums.agg(F.sum("a"), F.sum("b"), F.sum("n"), F.count("*")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((reps, 3))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                high, low, *values = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 8192).columns)
                for rep in range(0, reps, 128):
                    some = np.arange(rep, min(rep + 128, reps))
                    out[some] += draws(seed, some, high, low) @ np.column_stack(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), *(pa.array(out[:, k].copy()) for k in range(3))], names=["rep", "a", "b", "n"])

    drawn = sums.mapInArrow(run, "rep long, a double, b double, n double")
    # a replicate that drew nothing says nothing
    each = drawn.groupBy("rep").agg((F.try_divide(F.sum("b") - F.sum("a"), F.sum("n"))).alias("v"))
    tail = (1 - level) / 2
    band = each.agg(F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    return band.select(F.lit((total_b - total_a) / total).alias("estimate"), F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"), F.lit(clusters).alias("clusters"), F.lit(reps).alias("reps"))


def residual_interval(df: DataFrame, y: str, yhat: str, share: float = 0.8, least: int = 2, fallback: float = 250.0) -> DataFrame:
    """One row (mean_residual, half_width, fallback): the absolute residuals' mean and quantile; a named fallback width for too few rows."""
    df = stored(df.select(F.abs(F.col(yhat) - F.col(y)).alias("r")))
    rows = df.agg(F.avg("r").alias("mean_residual"), F.count("*").alias("n"))
    width = quantiles_by(df, [], "r", {"width": share}).first()  # one number
    few = F.col("n") < least
    return rows.select("mean_residual", F.when(few, fallback).otherwise(F.lit(width and width.width)).alias("half_width"), few.alias("fallback"))


def prediction_range(predicted: Column, half_width: Column, low: float = 800, high: float = 3500, least: float = 50) -> tuple[Column, Column, Column]:
    """Value to the nearest 100 (half to even) within bounds, and a low and a high end, low <= high."""
    near = lambda x: F.bround(x / 100) * 100
    clamp = lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    width = F.greatest(half_width, F.lit(float(least)))
    a, b = clamp(near(predicted - width)), clamp(near(predicted + width))
    return clamp(near(predicted)), F.least(a, b), F.greatest(a, b)


def set_diff(a: DataFrame, b: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(keys..., side) of the keys on one side only; a key with a null is like no other. Both sides are dealt by key into `parts` tasks, each row once."""
    flag = lambda df, x, y: df.select(*keys, F.lit(x).alias("_a"), F.lit(y).alias("_b"))
    both = flag(a, True, False).unionByName(flag(b, False, True))
    both = both.repartition(parts, *keys) if parts else both
    found = both.groupBy(*keys).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    sides = F.array_compact(F.array(F.when(F.col("_a") & (alone | ~F.col("_b")), F.lit("first")), F.when(F.col("_b") & (alone | ~F.col("_a")), F.lit("second"))))
    return found.select(*keys, F.explode(sides).alias("side"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def result_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The listed columns that exist, sorted."""
    return df.select(*(c for c in columns if c in df.columns)).orderBy(*order)


def stable_sort(df: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Several keys, nulls last, the full key as tie-break."""
    return df.orderBy(*(F.asc_nulls_last(k) for k in [*keys, *tie]))


def recheck_selection(metrics: DataFrame, lock: DataFrame, by: list[str], candidate: str, metric: str) -> DataFrame:
    """(by..., candidate, problem): stored winners that are missing, not finite, or no longer the lowest."""
    best = best_by(metrics, by, metric, [candidate]).select(*by, F.col(candidate).alias("best"))
    values = metrics.select(*by, candidate, F.col(metric).alias("_value"), F.lit(True).alias("_there"))
    rows = lock.join(values.hint("merge"), [*by, candidate], "left").join(best.hint("merge"), by, "left")
    finite = F.coalesce(~F.isnan("_value") & (F.abs("_value") < float("inf")), F.lit(False))
    problem = F.when(F.col("_there").isNull(), "missing").when(~finite, "not finite").when(F.col("best") != F.col(candidate), "not the lowest")
    return rows.select(*by, candidate, problem.alias("problem")).filter("problem is not null")
