"""Leakage-safe splits: whole groups or whole instants go to train, validation or test; rolling folds; audits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.operators.ranks import at_places, in_ranges, numbered
from veridra.sources.workspace import stored

NAMES = ("train", "valid", "test")
SCALE = 10_000


def partition_counts(n: Column, ratios: tuple[float, float, float]) -> list[Column]:
    """Integer counts by largest remainder, ties in the order train, valid, test; an empty part takes one from the largest.
    Fewer than three is an error."""
    parts = [round(r * SCALE) for r in ratios]
    if sum(parts) != SCALE or min(parts) <= 0:
        raise ValueError("ratios must be positive and sum to one")
    n = F.when(n < 3, F.raise_error(F.lit("fewer than three groups")).cast("long")).otherwise(n.cast("long"))
    floors = [F.floor(n * p / SCALE).cast("long") for p in parts]
    rests = [n * p % SCALE for p in parts]
    left = n - sum(floors[1:], floors[0])
    counts = []
    for i, rest in enumerate(rests):
        before = F.lit(0)
        for j, other in enumerate(rests):
            if j != i:
                before = before + ((other > rest) | ((other == rest) & F.lit(j < i))).cast("int")
        counts.append(floors[i] + (before < left).cast("long"))
    # an empty part takes one from the first largest
    taken = lambda c, i: F.transform(c, lambda x, j: F.when(j == i, x + 1).when(j == F.array_position(c, F.array_max(c)) - 1, x - 1).otherwise(x))
    fixed = F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(*counts), lambda c, i: F.when(F.get(c, i) == 0, taken(c, i)).otherwise(c))
    return [F.get(fixed, F.lit(i)) for i in range(3)]


def _cut(df: DataFrame, key: str, order: list[Column], ratios: tuple[float, float, float]) -> DataFrame:
    """Add fold and split_name by the place of `key` in the order, which is one of it alone; rows without a key are dropped. Only distinct groups or instants are dealt by the
    order; the last ones of train and validation are looked up there, and each row is compared with those two where it lies."""
    dealt, sizes = in_ranges(df.select(key).distinct(), order)
    n = dealt.count()
    a, b, _ = df.sparkSession.range(1).select(*partition_counts(F.lit(n), ratios)).first() if n else (0, 0, 0)
    place = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    last = lambda rank: F.max(F.when(F.col("_rank") == rank, place))
    ends = stored(at_places(dealt, sizes, order, [a, a + b], "_rank").agg(last(a).alias("_train"), last(a + b).alias("_valid")), "ends")  # one row
    fold = F.when(place <= F.col("_train"), 0).when(place <= F.col("_valid"), 1).otherwise(2)
    rows = df.filter(F.col(key).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("fold", fold)
    rows = rows.withColumn("split_name", F.element_at(F.array(*map(F.lit, NAMES)), F.col("fold") + 1))
    return rows.select(key, *(c for c in df.columns if c != key), "fold", "split_name")


def group_split(df: DataFrame, group: str, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """Add split_name and fold: whole groups, in the order of a seeded hash."""
    kind = dict(df.dtypes)[group]
    at = (F.col(group) + F.lit(0.0)).cast(kind) if kind in ("float", "double") else F.col(group)  # -0.0 and 0.0 are one group
    return _cut(df, group, [F.md5(F.concat(F.lit(f"{seed}:"), at.cast("string"))), at], ratios)


def time_split(df: DataFrame, time: str, ratios: tuple[float, float, float]) -> DataFrame:
    """Add split_name and fold: whole instants in time order; a null instant is an error."""
    if df.filter(F.col(time).isNull()).limit(1).count():
        raise ValueError(f"null in {time}")
    return _cut(df, time, [F.col(time)], ratios)


def assignment(df: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """(keys..., split_name, fold, strategy), sorted."""
    return df.select(*keys, "split_name", "fold", F.lit(strategy).alias("strategy")).orderBy(*keys)


def validate_split_input(df: DataFrame, keys: list[str], group: str, time: str) -> DataFrame:
    """(check, violations): null keys, duplicate keys, groups with several times."""
    nulls = df.agg(F.count_if(F.greatest(*(F.col(k).isNull() for k in keys))).alias("violations")).select(F.lit("null keys").alias("check"), "violations")
    twice = df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("duplicate keys").alias("check"), "violations")
    times = df.groupBy(group).agg(F.count_distinct(time).alias("n")).filter("n > 1").agg(F.count("*").alias("violations")).select(F.lit("groups with several times").alias("check"), "violations")
    return nulls.union(twice).union(times)


def audit_split(df: DataFrame, split: DataFrame, keys: list[str], time: str, parts: int | None = None) -> DataFrame:
    """(check, violations) of a split of `df`: completeness, one row per key, no empty part, no shared instant, strict order. Rows of both sides meet once, dealt
    by key into `parts` tasks; all checks follow from counts per instant and part."""
    sides = df.select(*keys, F.struct(F.col(time).alias("t")).alias("_t"), F.lit(None).cast("string").alias("_s"), F.lit(1).alias("_a"))
    sides = sides.unionByName(split.select(*keys, F.lit(None).cast(sides.schema["_t"].dataType).alias("_t"), F.col("split_name").alias("_s"), F.lit(0).alias("_a")))
    sides = sides.repartition(parts, *keys) if parts else sides
    rows = sides.groupBy(*keys).agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("s"), F.collect_set("_t").alias("times"), F.collect_set("_s").alias("names"))
    met = (F.col("a") > 0) & (F.col("s") > 0)
    for k in keys:
        met = met & F.col(k).isNotNull()
    entry = lambda t, s, m, a=0, b=0, c=0: F.struct(t.alias("t"), s.alias("s"), F.lit(m).alias("met"), *(F.lit(x).cast("long").alias(n) for n, x in (("unassigned", a), ("unknown", b), ("twice", c))))
    none = F.lit(None).cast(df.schema[time].dataType), F.lit(None).cast("string")
    counts = F.array(entry(*none, False, F.when(met, 0).otherwise(F.col("a")), F.when(met, 0).otherwise(F.col("s")), (F.col("s") > 1).cast("int")))
    there = F.transform("names", lambda n: entry(none[0], n, False))
    pairs = F.when(met, F.flatten(F.transform("times", lambda t: F.transform("names", lambda n: entry(t["t"], n, True))))).otherwise(F.slice(there, 1, 0))
    facts = rows.select(F.inline(F.concat(counts, there, pairs))).groupBy("t", "s", "met").agg(*(F.sum(c).alias(c) for c in ("unassigned", "unknown", "twice")))
    facts = stored(facts, "audit")
    one = lambda name, frame: frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    total = lambda name, c: facts.agg(F.coalesce(F.sum(c), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    out = total("unassigned rows", "unassigned").union(total("unknown rows", "unknown")).union(total("duplicate assignments", "twice"))
    named = split.sparkSession.createDataFrame([(x,) for x in NAMES], "s string")
    out = out.union(one("empty splits", named.join(facts.select("s").distinct(), "s", "left_anti")))
    joined = facts.filter("met")
    out = out.union(one("shared instants", joined.groupBy("t").agg(F.count_distinct("s").alias("n")).filter("n > 1")))
    edges = joined.agg(*(f(F.when(F.col("s") == s, F.col("t"))).alias(f"{w}_{s}") for s in NAMES for w, f in (("lo", F.min), ("hi", F.max))))
    late = edges.filter("not (hi_train < lo_valid and hi_valid < lo_test)")
    return out.union(one("order broken", late))


def group_times(df: DataFrame, group: str, time: str) -> DataFrame:
    """(group, time): each group's first time, nulls dropped, sorted. Fewer than four groups are an error."""
    out = df.dropna(subset=[group, time]).groupBy(group).agg(F.min(time).alias(time))
    if out.limit(4).count() < 4:
        raise ValueError("fewer than four groups")
    return out.orderBy(time, group)


@dataclass(frozen=True)
class Windows:
    """Expanding training windows over ranked groups, each with the test window after it: (fold, last train rank, last test rank). Their bounds cut the ranks into
    segments; every window is a run of segments, so sums per segment add up to any window's."""

    bounds: list[tuple[int, int, int]]

    @property
    def cuts(self) -> list[int]:
        return sorted({x for _, a, b in self.bounds for x in (a, b)})

    def segment(self, rank: Column) -> Column:
        """The number of the segment that a rank lies in; ranks after all windows lie in the last one."""
        return reduce(lambda x, y: x + y, [(rank > c).cast("int") for c in self.cuts], F.lit(0))

    def of(self, fold: int, part: str) -> list[int]:
        """The segments of a window."""
        a, b = next((a, b) for f, a, b in self.bounds if f == fold)
        first, last = self.cuts.index(a), self.cuts.index(b)
        return list(range(first + 1)) if part == "train" else list(range(first + 1, last + 1))

    def table(self) -> list[tuple[int, str, int]]:
        """(fold, part, segment), a few rows for each fold."""
        return [(f, p, s) for f, _, _ in self.bounds for p in ("train", "test") for s in self.of(f, p)]


def window_bounds(n: int, shares: list[float], test: float) -> Windows:
    """Windows over n ranks. Bounds are rounded half to even; each side has one group at least."""
    bounds = []
    for i, share in enumerate(shares):
        a = min(max(1, round(n * share)), n - 1)
        bounds.append((i + 1, a, min(n, max(a + 1, round(n * (share + test))))))
    return Windows(bounds)


def fold_segments(times: DataFrame, group: str, time: str, shares: list[float], test: float) -> tuple[DataFrame, Windows]:
    """(group, segment), a row per group, and the windows that the segments make up."""
    ranked, n = numbered(times, [F.col(time), F.col(group)], "rk")
    windows = window_bounds(n, shares, test)
    return ranked.select(group, windows.segment(F.col("rk")).alias("segment")), windows


def rolling_folds(times: DataFrame, group: str, time: str, shares: list[float], test: float) -> DataFrame:
    """(fold, group, part): expanding training windows over groups in time order, each followed by its test window. The folds are a small
    literal table that ranks are compared with."""
    ranked, n = numbered(times, [F.col(time), F.col(group)], "rk")
    folds = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, a, b in window_bounds(n, shares, test).bounds))
    spread = ranked.select(group, "rk", F.explode(F.filter(folds, lambda f: F.col("rk") <= f["b"])).alias("f"))
    return spread.select(F.col("f.fold").alias("fold"), group, F.when(F.col("rk") <= F.col("f.a"), "train").otherwise("test").alias("part"))


def holdout_split(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """Add `held`: a seeded random share (rounded up, two at least) of the rows; none if fewer than six rows or three would be left.
    The hash that cuts the share off is found by counts per hash range, then within one range."""
    n = df.count()
    k = max(2, -int(-n * share // 1))
    if n < 6 or n - k < 3:
        return df.withColumn("held", F.lit(False))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys)))
    rows = df.withColumn("_h", h)
    ranges = rows.groupBy(F.substring("_h", 1, 3).alias("r")).count().orderBy("r").collect()  # 4096 at most
    before = 0
    for r in ranges:
        if before + r["count"] >= k:
            last = rows.filter(F.substring("_h", 1, 3) == r.r).select("_h").orderBy("_h").limit(k - before).agg(F.max("_h")).first()[0]
            return rows.withColumn("held", F.col("_h") <= last).drop("_h")
        before += r["count"]
    return rows.withColumn("held", F.lit(True)).drop("_h")
