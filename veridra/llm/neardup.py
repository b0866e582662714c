"""MinHash near-duplicate detection.

Many universal hash minima per document, banded into buckets; each bucket's members are compared with one of
them, what is left in several components is compared in full; links hold only if the full shingle sets say so;
components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import U64, WordHash, list_column, mix, release, shingle_hashes, slices, text_bytes, written


@dataclass(frozen=True)
class NearDupConfig:
    """k words make a shingle; texts link from `percent`/100 on.

    With bands x rows minima, a pair of similarity s meets in no bucket with probability
    (1 - s**rows)**bands: 7e-9 at 0.85 with the defaults, 3e-6 at 0.8 (1e-7 with 40 bands).
    `slack` is how far the signature's estimate may fall short of the threshold before a pair is
    given up without reading its sets (0.2 is over five standard deviations of 160 minima).
    """

    k: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 5
    slack: float = 0.2
    seed: int = 42


def _universal(cfg: NearDupConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    n = cfg.bands * cfg.rows
    return rng.integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=np.int64).astype(U64)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each multiply-shift hash, as its upper 32 bits."""
    best = np.full(len(a), np.iinfo(np.uint64).max, U64)
    for at in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[at : at + 1024, None] * a + b).min(axis=0), out=best)
    return (best >> U64(32)).astype(np.uint32)


def _words(text: str | None) -> list[bytes]:
    """ASCII lower case, cut at blanks; bytes.split() cuts at exactly space and 09-0D."""
    return text_bytes(text).lower().split()


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str, text_col: str, cfg: NearDupConfig) -> DataFrame:
    """(id, key, n, bands): `key` names the word sequence, `n` is the set size, `bands` one hash per band (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (a, b) = WordHash(), _universal(cfg)
        weights = mix(np.arange(1, cfg.rows + 1, dtype=U64)) | U64(1)
        for batch in batches:
            for piece in slices(batch, 1000, 1):
                keys, sizes, bands = [], [], []
                for text in piece.column(1):
                    words = _words(text.as_py())
                    s = shingle_hashes(words, cfg.k, seen)
                    keys.append(_key(words))
                    sizes.append(len(s))
                    if len(s):
                        m = _minima(s, a, b).astype(U64).reshape(cfg.bands, cfg.rows)
                        bands.append(mix((m * weights).sum(axis=1) + mix(np.arange(cfg.bands, dtype=U64))).view(np.int64))
                    else:
                        bands.append(np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), list_column(bands, pa.int64())],
                    names=["id", "key", "n", "bands"],
                )
        seen.clear()
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, key binary, n long, bands array<long>")


def features(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Signature and full shingle set of the `wanted` (node, key) texts, made anew from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (a, b) = WordHash(), _universal(cfg)
        for batch in batches:
            for piece in slices(batch, 500, 2):
                ids, sigs, sets = [], [], []
                for node, key, text in zip(*(piece.column(i) for i in range(3))):
                    words = _words(text.as_py())
                    if _key(words) == key.as_py():
                        s = shingle_hashes(words, cfg.k, seen)
                        ids.append(node.as_py())
                        sigs.append(_minima(s, a, b).view(np.int32))
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_column(sigs, pa.int32()), list_column(sets, pa.int64())], names=["node", "sig", "grams"])
        seen.clear()
        release()

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    found = wanted.join(texts.hint("merge"), "node").select("node", "key", "t")
    return found.mapInArrow(run, "node long, sig array<int>, grams array<long>")


def _linked(cfg: NearDupConfig) -> Column:
    """The sets of sides a and b are alike enough: 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect("a.grams", "b.grams"))
    return 100 * both >= cfg.percent * (F.size("a.grams") + F.size("b.grams") - both)


def _agrees(cfg: NearDupConfig) -> Column:
    """The signatures' estimate is not far below the threshold."""
    same = F.size(F.filter(F.zip_with("a.sig", "b.sig", lambda x, y: x == y), lambda z: z))
    return same >= int((cfg.percent / 100 - cfg.slack) * cfg.bands * cfg.rows)


def confirm(pairs: DataFrame, feats: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The (u, v) pairs, u > v, whose signatures agree and whose full sets confirm the link."""
    with_a = pairs.join(feats.select(F.col("node").alias("u"), F.struct("sig", "grams").alias("a")).hint("merge"), "u")
    both = with_a.join(feats.select(F.col("node").alias("v"), F.struct("sig", "grams").alias("b")).hint("merge"), "v")
    return both.filter(_agrees(cfg)).filter(_linked(cfg)).select("u", "v").distinct()


def _large_star(edges: DataFrame, salts: int = 8) -> DataFrame:
    """Over (u, v) edges, u > v: the larger neighbours of every node are tied to the smallest node around it. A node that a third of all edges
    meet in is dealt over several tasks; only nodes with larger neighbours are repeated for that, and those are few after the first round."""
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).filter("most > u").select("u", F.least("u", "m").alias("m"))
    least = least.select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int").alias("salt"))
    return dealt.join(least.hint("merge"), ["v", "salt"]).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Over (u, v) edges, u > v: every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.select("u", "v").join(least.hint("merge"), "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges, u > v -> (node, root) for every node that is not its component's smallest.

    Alternating large-star and small-star until nothing moves. Every step is a grouped minimum and a join, so no
    node's neighbours are gathered anywhere; each round is written to the shared folder.
    """
    state, now = None, written(edges.select("u", "v").distinct(), "edges")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, now = mark, written(_small_star(_large_star(now)), "edges")


def _alive(feats: DataFrame, members: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(node, n, s) of the members of whose n shingles at least `percent` % occur in another member too; no other can have a
    link. `s` counts those: no member has more in common with any other."""
    grams = feats.join(members.hint("merge"), "node", "left_semi").select("node", F.explode("grams").alias("g"))
    shared = grams.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    kept = grams.join(shared.hint("merge"), "g", "left_semi").groupBy("node").agg(F.count("*").alias("s"))
    sizes = feats.select("node", F.size("grams").alias("n"))
    return kept.join(sizes.hint("merge"), "node").filter(100 * F.col("s") >= cfg.percent * F.col("n")).select("node", "n", "s")


def _links(nodes: np.ndarray, roots: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """(u, v) of the linked pairs of different roots, one of `left` and one of `right`. Common shingles are counted by
    multiplying 0/1 matrices over those that at least two sets hold, some thousands at a time."""
    sizes = np.array([len(g) for g in grams])
    values, spot, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[spot]
    row = np.repeat(np.arange(len(grams)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        held = np.zeros((len(grams), width), np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        both += held[left] @ held[right].T
    both = both.astype(np.int64)
    fit = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    for i, j in zip(*np.nonzero(fit & (roots[left][:, None] != roots[right][None, :]))):
        x, y = int(nodes[left[i]]), int(nodes[right[j]])
        yield max(x, y), min(x, y)


def _compared(rest: DataFrame, feats: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Links between members of different components of one bucket: every pair is compared on its full sets.

    A bucket's members are dealt into blocks of bounded size by a hash, and every two blocks of it (or one, if all fit) form a
    group, so a set is sent once per pair of blocks and not once per pair of texts."""
    room, most = 1_000_000, 1024
    sizes = rest.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    blocks = F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("total") / room)).cast("int").alias("blocks")
    dealt = rest.select("h", "node", "root").join(sizes.select("h", blocks).hint("merge"), "h")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root")
    full = dealt.join(feats.select("node", "grams").hint("merge"), "node")
    parts = max(1, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = full.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def found() -> pa.RecordBatch:
            nodes, own, roots = (np.array([r[k] for r in group], np.int64) for k in range(3))
            left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
            links = list(_links(nodes, roots, [r[3] for r in group], left, right, cfg.percent)) if len(left) and len(right) and (roots != roots[0]).any() else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for node, h, i, j, own, root, grams in zip(*(batch.column(k) for k in range(7))):
                here = (h.as_py(), i.as_py(), j.as_py())
                if here != key:
                    if len(group) > 1:
                        yield found()
                    key, group = here, []
                group.append((node.as_py(), own.as_py(), root.as_py(), grams.values.to_numpy()))
        if len(group) > 1:
            yield found()
        group.clear()
        release()

    return grouped.select("node", "h", "i", "j", "own", "root", "grams").mapInArrow(run, "u long, v long").filter("u > v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Each row's shingle count, component (smallest id reachable) and whether it is the one to keep.

    Returns (doc_id, n_shingles, component_id, kept), one row per input row. Null or blank text: an empty set, linked
    with nothing, kept. Null id: linked with nothing, component null, not kept. Rows with one id are one node: repeated rows
    get equal results. Other columns are not looked at. An empty table gives an empty result.

    Texts with the same words are one class and enter the buckets once. A bucket's members are compared with one of
    them, another in each band; then those of a bucket that are still in different components are compared
    pairwise in blocks, after members that too few others resemble are set aside by counting. Small sides of joins are
    written first: Spark can then split a hot bucket, class or node over several tasks.
    """
    rows = written(sketch(docs, id_col, text_col, cfg), "sketch")
    nodes = rows.filter("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("node"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    slots = nodes.select("node", "key", F.posexplode("bands").alias("band", "h"))

    # another member leads each band's bucket, so that a group hangs together even if one leader is an outlier
    led = slots.groupBy("h").agg(F.min_by("node", F.xxhash64("node", "band")).alias("v"), F.count("*").alias("c")).filter("c > 1").select("h", "v")
    led = written(led, "leaders")
    busy = written(slots.join(led.hint("merge"), "h"), "busy")
    pairs = busy.filter("node != v").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()
    feats = written(features(docs, id_col, text_col, busy.select("node", "key").distinct(), cfg), "features")
    edges = written(confirm(pairs, feats, cfg), "links")
    roots = components(edges)

    rest = busy.select("node", "band", "h").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rest.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    rest = written(rest.join(open_.hint("merge"), "h", "left_semi"), "open")
    alive = written(_alive(feats, rest.select("node").distinct(), cfg), "alive")
    more = _compared(rest.join(alive.hint("merge"), "node"), feats, cfg)
    extra = written(more, "links")
    if not extra.isEmpty():
        roots = components(edges.union(extra))

    keys = nodes.select("key", "node").join(roots.hint("merge"), "node", "left").select("key", F.coalesce("root", "node").alias("c"))
    keys = written(keys, "classes")
    named = rows.filter("n > 0 and id is not null").join(keys.hint("merge"), "key").select("id", "n", "c")
    lone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("c"))
    return named.union(lone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))
