"""Places in a total order and exact quantiles, for tables of any size: ranges of the order are dealt to tasks, and what lies before a
range is added up from counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.sources.workspace import stored


def how(small: DataFrame, most: int = 32 << 20) -> str:
    """Join hint for a small table: broadcast up to a checked number of bytes, measured as the table's text."""
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return "broadcast" if (size or 0) <= most else "merge"


def in_ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with `_range`, dealt by ranges of the order and written, so that their ranges stand still; a row per range with `_n`, its rows, and `_before`, those of all
    ranges before)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    return dealt, dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """(rows with `name`, their place from 1 in the order; the number of rows). Each row is numbered within its range, after the rows of all ranges before."""
    dealt, sizes = in_ranges(df, order)
    rows = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return rows.join(F.broadcast(sizes.drop("_n")), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before"), dealt.count()


def at_places(dealt: DataFrame, sizes: DataFrame, order: list[Column], places: list[int], name: str) -> DataFrame:
    """The rows at some places from 1 in the order, with `name`, their place. Of what `in_ranges` made, only the ranges that hold such a place are put in order."""
    wanted = F.array(*(F.lit(p).cast("long") for p in places))
    here = sizes.filter(F.exists(wanted, lambda p: (p > F.col("_before")) & (p <= F.col("_before") + F.col("_n"))))
    rows = dealt.join(F.broadcast(here), "_range").withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before"))
    return rows.filter(F.array_contains(wanted, F.col(name))).drop("_range", "_n", "_before")


#: bits of a double's image that one step looks at
STEP = 16


def image(v: Column) -> Column:
    """A double's 64 bits as a long in the order of the doubles: those of negative numbers are turned. -0.0 is 0.0, and NaN comes last."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(2**63 - 1)))


def quantiles_by(df: DataFrame, by: list[str], col: str, qs: dict[str, float], per_cell: int = 1_000_000, into: tuple[list[str], Callable[[Column], Column]] | None = None) -> DataFrame:
    """(by..., _k, n, a column per name of `qs`): exact quantiles of the non-null values with linear interpolation. `_k` holds `by` as one
    struct, for joins in which null is a key like others. `df` is read twice or a few times more; give it stored.

    With `into` = (names, function) the groups of `by` are parts of larger, perhaps overlapping ones: the function makes an array of structs of
    those names from the struct of `by`, and the result has a row per such struct. Parts are merged as counts; no row is copied.

    Radix selection on the values' 64-bit images: rows are counted per group and leading 16 bits, and sums of the counts tell the cell in which a
    quantile's rank lies. Cells of more than `per_cell` rows are counted by the next 16 bits; of the others the distinct values are counted and
    ordered. A row's work is the same for tables of any size, counts are added up before every shuffle, and what is joined to the rows is a few
    cells per group and quantile.
    """
    rows = df.select(F.struct(*(F.col(c) for c in by), F.lit(0).alias("_")).alias("_part"), F.col(col).cast("double").alias("v")).filter("v is not null").withColumn("bits", image(F.col("v")))
    names = into[0] if into else by
    # the key of each larger group, with a last field that makes it a struct even where it has no other
    targets = lambda part: F.transform(into[1](part), lambda t: F.struct(*(t[c].alias(c) for c in names), F.lit(0).alias("_"))) if into else F.array(part)
    spread = lambda counts: counts.withColumn("_k", F.explode(targets(F.col("_part")))) if into else counts.withColumn("_k", F.col("_part"))
    spots = {k: F.lit(q) * (F.col("n") - 1) for k, q in qs.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(s), F.ceil(s)) for s in spots.values()))))
    inside = lambda c: F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col(c)))
    upto = lambda *parts: Window.partitionBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    shift = 64 - STEP
    counted = stored(rows.groupBy("_part", F.shiftright("bits", shift).alias("cell")).agg(F.count("*").alias("c")), "counts")
    counts = spread(counted).groupBy("_k", "cell").agg(F.sum("c").alias("c"))
    groups = stored(counts.groupBy("_k").agg(F.sum("c").alias("n")), "groups")
    parts = stored(spread(counted.select("_part").distinct()), "parts")
    # 65,536 rows a group at most, in this window and in those of later steps
    placed = counts.join(groups.select("_k", ranks.alias("ranks")).hint(how(groups)), "_k").withColumn("before", F.coalesce(F.sum("c").over(upto("_k").orderBy("cell")), F.lit(0)))
    cells = stored(placed.select("_k", "cell", "before", "c", inside("c").alias("ranks")).filter(F.size("ranks") > 0), "cells")

    def counted_in(cells: DataFrame, shift: int, last: Column, name: str) -> DataFrame:
        """The rows of the cells, counted by something finer: per part, then per group and cell."""
        wanted = stored(cells.join(parts.hint(how(parts)), "_k").select("_part", "cell").distinct(), "wanted")
        here = rows.withColumn("cell", F.shiftright("bits", shift)).join(wanted.hint(how(wanted)), ["_part", "cell"]).groupBy("_part", "cell", last.alias(name)).agg(F.count("*").alias("c"))
        return spread(here).join(cells.drop("c").hint(how(cells)), ["_k", "cell"]).groupBy("_k", "cell", "before", "ranks", name).agg(F.sum("c").alias("c"))

    while shift and (cells.agg(F.max("c")).first()[0] or 0) > per_cell:
        shift -= STEP
        finer = counted_in(cells, shift + STEP, F.shiftright("bits", shift), "next")
        finer = finer.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(upto("_k", "cell").orderBy("next")), F.lit(0)))
        cells = stored(finer.select("_k", F.col("next").alias("cell"), "before", "c", inside("c").alias("ranks")).filter(F.size("ranks") > 0), "cells")
    near = counted_in(cells, shift, F.col("v"), "v")
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(upto("_k", "cell").orderBy("v")), F.lit(0)))
    # two values a quantile and group at most
    found = near.select("_k", "v", F.explode(inside("c")).alias("r")).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    lo, hi = ({k: F.element_at("at", f(s)) for k, s in spots.items()} for f in (F.floor, F.ceil))
    values = {k: lo[k] + (hi[k] - lo[k]) * (s - F.floor(s)) for k, s in spots.items()}
    return found.join(groups.hint("merge"), "_k").select(*(F.col("_k")[c].alias(c) for c in names), "_k", "n", *(v.alias(k) for k, v in values.items()))


def with_quantiles(groups: DataFrame, values: DataFrame, by: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    """The table of groups with a column per quantile of `col` among `values`; null for groups without a value."""
    found = quantiles_by(values, by, col, qs).select("_k", *qs)
    keyed = groups.withColumn("_k", F.struct(*(F.col(c) for c in by), F.lit(0).alias("_")))
    return keyed.join(found.hint("merge"), "_k", "left").drop("_k")
