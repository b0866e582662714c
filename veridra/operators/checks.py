"""Filters with accounts of what they removed, keys, guards, and audits of tables and files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_report(df: DataFrame, conditions: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all conditions, and (condition, removed) with every condition counted by itself; null counts as not met."""
    met = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    counts = df.agg(F.count("*").alias("rows_before"), *(F.count_if(~c).alias(n) for n, c in met.items()), F.count_if(_all(met.values())).alias("rows_after"))
    return df.filter(_all(met.values())), counts.unpivot([], counts.columns, "condition", "removed")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def fail_if(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """The rows, but the job fails at the first that is broken."""
    return df.filter(F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of the non-null keys that occur more than once."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """The frame itself; an error if a non-null key occurs twice."""
    found = duplicate_keys(df, keys).limit(1).count()
    if found:
        raise ValueError(f"{name} has duplicate keys ({', '.join(keys)})")
    return df


def select_item(df: DataFrame, key: dict[str, object], code: str, value: str) -> DataFrame:
    """The item of a key, its code compared without regard to case."""
    return df.filter(_all(F.col(k) == v for k, v in key.items()) & (F.upper(code) == value.strip().upper()))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null, NaN or infinite value in any of the columns."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns]
    out = F.lit(False)
    for b in bad:
        out = out | b
    return df.filter(out)


def assert_finite(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The frame; an error that names the first bad row by `names`."""
    first = non_finite(df, columns).orderBy(*names).select(*names).first()
    if first:
        raise ValueError(f"not finite: {first.asDict()}")
    return df


def strict_prepare(df: DataFrame, kinds: Mapping[str, str], keys: list[str], required: list[str], time: str) -> DataFrame:
    """Project and cast an allow-list; a null in `required` or a duplicate key is an error. Sorted by time, then key."""
    out = df.select(*(F.col(c).try_cast(t).alias(c) for c, t in kinds.items()))
    missing = out.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).first().asDict()
    if any(missing.values()):
        raise ValueError(f"nulls in {', '.join(c for c, n in missing.items() if n)}")
    return assert_unique(out, keys).orderBy(time, *keys)


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-12, atol: float = 1e-9) -> DataFrame:
    """(keys..., column, problem) of what differs: rows on one side, numbers beyond the tolerance, other texts (null equals "")."""
    values = [c for c in a.columns if c not in keys]
    if set(values) != {c for c in b.columns if c not in keys}:
        raise ValueError("tables have other columns")
    numeric = {f.name for f in a.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    x = a.select(*keys, F.struct(*values).alias("x"))
    y = b.select(*keys, F.struct(*values).alias("y"))

    def differs(c: str) -> Column:
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        if c in numeric:
            return ~F.coalesce((F.abs(p - q) <= atol + rtol * F.abs(q)) | (p.isNull() & q.isNull()), F.lit(False))
        return ~(F.coalesce(p.cast("string"), F.lit("")) == F.coalesce(q.cast("string"), F.lit("")))

    joined = x.join(y, keys, "full")
    problems = F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in values)))
    side = F.when(F.col("y").isNull(), F.array(F.lit("only in first"))).when(F.col("x").isNull(), F.array(F.lit("only in second"))).otherwise(problems)
    return joined.select(*keys, F.explode(side).alias("problem"))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(relative_path, problem): unsafe paths, duplicates, bad sizes and digests."""
    p = F.col("relative_path")
    unsafe = (p == "") | p.startswith("/") | p.contains("\\") | p.rlike(r"(^|/)\.\.?(/|$)") | p.rlike("^[A-Za-z]:")
    rows = manifest.withColumn("_n", F.count("*").over(Window.partitionBy("relative_path")))
    bad = F.array_compact(F.array(F.when(F.coalesce(unsafe, F.lit(True)), F.lit("unsafe path")), F.when(F.col("_n") > 1, F.lit("duplicate path")), F.when(F.coalesce(F.col("size_bytes") < 0, F.lit(True)), F.lit("bad size")), F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("bad digest"))))
    return rows.select("relative_path", F.explode(bad).alias("problem"))


def manifest_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, problem): missing, extra, or other digest, size or kind."""
    cols = ["sha256", "size_bytes", "kind"]
    e = expected.select("relative_path", F.struct(*cols).alias("e"))
    c = current.select("relative_path", F.struct(*cols).alias("c"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")), F.lit(k)) for k in cols)))
    problem = F.when(F.col("c").isNull(), F.array(F.lit("missing"))).when(F.col("e").isNull(), F.array(F.lit("extra"))).otherwise(changed)
    return e.join(c, "relative_path", "full").select("relative_path", F.explode(problem).alias("problem"))


def stamp(df: DataFrame, fingerprint: str, column: str = "config_fingerprint") -> DataFrame:
    return df.withColumn(column, F.lit(fingerprint))


def assert_fingerprint(df: DataFrame, expected: str, column: str = "config_fingerprint") -> DataFrame:
    """The frame; an error unless the column holds just the expected value."""
    found = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"fingerprints {found} instead of {expected}")
    return df
