"""Merkle manifest of a table: a tree of digests per group and one over the groups, and for every row the path that proves it.

A tree's rows are ranked; the digits of a rank in base `fan` are its way from the root. Blocks of fan ** levels rows are rolled up in place:
grouping by all digits but the last nests the children of every node into a struct, level by level, without another shuffle. The blocks'
roots are ranked rows again, so a few tiers reach the root of any table. The way back down is a transform of those nested structs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.llm.common import written

FAN, LEVELS = 8, 3
#: rows of path tables (some KB each) that may be broadcast; larger ones are merged
SMALL = 5_000


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def record_digest(values: list[Column]) -> Column:
    """Digest of one record: each value as its byte count, a colon and itself, or a dash where it is null."""
    shown = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)))


def _depth(n: Column, fan: int) -> Column:
    """Levels above n nodes: the least k with fan ** k >= n."""
    powers = [fan**k for k in range(63) if fan**k < 2**63]
    return reduce(lambda x, y: x + y, [(n > F.lit(p)).cast("int") for p in powers])


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `_rank`, the place from 0 among those of their `_g`, and `_n`, how many those are. Ranges of (`_g`, order) are dealt to tasks,
    so no group has to fit in one; what lies before a range is added up from a row per range and group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(parts, "_g", *order).sortWithinPartitions("_g", *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(at.withColumn("_range", F.shiftright("_at", 33)), "ranks")
    spans = dealt.groupBy("_g", "_range").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shift = F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")
    spans = written(spans.select("_g", "_range", shift.alias("_shift"), F.sum("_c").over(Window.partitionBy("_g")).alias("_n")), "spans")
    hint = "broadcast" if spans.count() <= 100_000 else "merge"
    return dealt.join(spans.hint(hint), ["_g", "_range"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _roll(nodes: DataFrame, carried: list[str], fan: int, levels: int) -> DataFrame:
    """Blocks of fan ** levels nodes (`_g`, `_rank`, `_n`, hash, carried) as one row each: `_rank` and `_n` of the blocks, hash, and the nested `node`.
    All rows of a block meet in the one shuffle by group and block; a block is bounded, whatever the group. Levels that a tree does not
    have keep their only child's hash."""
    digits = [f"_d{k}" for k in range(1, levels + 1)]
    places = [F.expr(f"_rank div {fan ** (k - 1)}L % {fan}").cast("int").alias(d) for k, d in enumerate(digits, 1)]
    rows = nodes.select("_g", "_n", F.expr(f"_rank div {fan**levels}L").alias("_block"), *places, F.struct("hash", *carried).alias("node"))
    rows = rows.repartition("_g", "_block")
    for k, digit in enumerate(digits, 1):
        rows = rows.groupBy("_g", "_block", "_n", *digits[k:]).agg(F.transform(F.sort_array(F.collect_list(F.struct(digit, "node"))), lambda x: x["node"]).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        own = F.when(_depth(F.col("_n"), fan) >= k, digest(joined)).otherwise(F.col("kids")[0]["hash"])
        rows = rows.select("_g", "_block", "_n", *digits[k:], F.struct(own.alias("hash"), "kids").alias("node"))
    return rows.select("_g", F.col("_block").alias("_rank"), "_n", F.expr(f"(_n - 1) div {fan**levels}L + 1").alias("_blocks"), F.col("node.hash").alias("hash"), "node")


def _tiers(nodes: DataFrame, carried: list[str], fan: int, levels: int) -> list[DataFrame]:
    """Blocks, blocks of blocks, and so on, until every group is one row."""
    tiers = [written(_roll(nodes, carried, fan, levels), "tier")]
    while (tiers[-1].agg(F.max("_blocks")).first()[0] or 1) > 1:
        tiers.append(written(_roll(tiers[-1].select("_g", "_rank", F.col("_blocks").alias("_n"), "hash"), [], fan, levels), "tier"))
    return tiers


def _beside(kids: Column, i: Column) -> Column:
    """The hashes to the left and to the right of child i, each as one string."""
    hashes = F.transform(kids, lambda k: k["hash"])
    left, right = (F.array_join(x, "") for x in (F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.size(hashes))))
    return F.struct(left.alias("left"), right.alias("right"))


def _children(real: Column, fan: int) -> Callable[[Column], Column]:
    """From a node with its place and path to its children with theirs; a level that is not `real` adds nothing to the path."""

    def down(way: Column) -> Column:
        kids = way["node"]["kids"]
        step = lambda i: F.when(real, F.concat(F.array(_beside(kids, i)), way["path"])).otherwise(way["path"])
        return F.transform(kids, lambda kid, i: F.struct(kid.alias("node"), (way["place"] * fan + i).alias("place"), step(i).alias("path")))

    return down


def _unroll(blocks: DataFrame, carried: list[str], fan: int, levels: int) -> DataFrame:
    """The nodes under every block (`_g`, `_rank`, `_up`, carried...) with `path`: their siblings level by level up to the block, then the block's own path."""
    ways = F.array(F.struct(F.col("node").alias("node"), F.col("_rank").alias("place"), F.col("path").alias("path")))
    for k in range(levels, 0, -1):
        ways = F.flatten(F.transform(ways, _children(_depth(F.col("_n"), fan) >= k, fan)))
    out = blocks.select("_g", "_up", F.explode(ways).alias("_w"))
    return out.select("_g", "_up", F.col("_w.place").alias("_rank"), F.col("_w.path").alias("path"), *(F.col(f"_w.node.{c}").alias(c) for c in ["hash", *carried]))


def _descend(tiers: list[DataFrame], tops: DataFrame, carried: list[str], fan: int, levels: int) -> DataFrame:
    """All nodes below the last tier's rows, whose path and `_up` columns `tops` (`_g`, path, `_up`) gives. A block's nodes find their
    siblings inside the block; only a row per block is joined to the path above it."""
    above = tops.withColumn("_rank", F.lit(0).cast("long"))
    for t in range(len(tiers) - 1, -1, -1):
        upper = written(above.select("_g", "_rank", "path", "_up"), "paths") if t < len(tiers) - 1 else above
        hint = "broadcast" if upper.count() <= SMALL else "merge"
        above = _unroll(tiers[t].join(upper.hint(hint), ["_g", "_rank"]), carried if t == 0 else [], fan, levels)
    return above


def merkle_manifest(
    df: DataFrame, fields: list[str], id_col: str, group_col: str, claimed: dict[str, Column] | None = None, fan: int = FAN, levels: int = LEVELS
) -> DataFrame:
    """One row per row: (id, group, leaf, subroot, root, path, claimed_leaf). `leaf` is the digest of `fields`; per value of `group_col`
    leaves ascend by `id_col` and every `fan` consecutive nodes, the last ones fewer, make a parent until one is left, the subroot. Subroots
    in the order of their groups (null first, then by UTF-8 bytes) make the root alike. `path` is an array of (left, right): the siblings'
    digests joined, from the leaf's level to the root. `claimed` replaces fields as somebody else's copy has them; `claimed_leaf` is the digest
    of that copy, to be verified against the path.

    Nulls are values: ids sort first, groups make one of their own. Rows of one id are ordered by their leaves, so equal rows have equal
    leaves side by side. A lone leaf is its subroot and a lone subroot the root, with an empty path. An empty table gives no rows. Texts of any
    length are hashed where they lie and not moved. Other columns are not looked at, whatever their names.

    A group may hold any share of the rows: ranks come from ranges, and what a task nests is a block of fan ** levels leaves.
    """
    value = {f: F.col(f"`{f}`") for f in fields}
    other = record_digest([(claimed or {}).get(f, value[f]) for f in fields])
    group = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))  # null first, and a key in joins
    leaves = df.select(group.alias("_g"), F.col(f"`{id_col}`").alias("id"), record_digest(list(value.values())).alias("hash"), other.alias("claimed"))
    carried = ["id", "claimed"]
    ranked = _ranked(written(leaves, "leaves"), ["id", "hash", "claimed"])
    tiers = _tiers(ranked, carried, fan, levels)
    groups = tiers[-1].select(F.lit("").alias("_g"), F.col("_g").alias("group"), "hash")
    over = _tiers(_ranked(groups, ["group"]), ["group"], fan, levels)
    top = over[-1].select("_g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.struct(F.col("hash").alias("root")).alias("_up"))
    subroots = written(_descend(over, top, ["group"], fan, levels).select(F.col("group").alias("_g"), "path", F.struct(F.col("hash").alias("subroot"), "_up.root").alias("_up")), "subroots")
    rows = _descend(tiers, subroots, carried, fan, levels)
    return rows.select("id", F.when(F.col("_g") != "", F.substring("_g", 2, 2**31 - 1)).alias("group"), F.col("hash").alias("leaf"), "_up.subroot", "_up.root", "path", F.col("claimed").alias("claimed_leaf"))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of a path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's level up, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Prove every document, and verify a copy in which the texts of the documents whose id's CRC-32 three divides are lower-cased (A-Z):
    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, plain).otherwise(F.col("text"))
    rows = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"text": changed})
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.col("claimed_leaf")))
    proof = proof_digest(F.col("path")).alias("proof_sha256")
    return rows.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
