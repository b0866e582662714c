"""Exact top-k by inner product without random access: sorted lists are read in steps, bounds decide when to stop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.llm.common import written

LIMIT = 2**24


@dataclass(frozen=True)
class TopKConfig:
    """`block` candidates meet `queries` queries in one task; `depths` are the shares of the lists read before each look at the bounds."""

    k: int = 5
    block: int = 8192
    queries: int = 2048
    scale: float = 256.0
    depths: tuple[float, ...] = (0.5, 0.9)


def _shares(block: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the first `depth` entries of each dimension's list hold, read from the top and from the bottom: the unread
    entries as 0/1 masks, and the value at which each reading stands."""
    n = len(block)
    ranks = np.empty(block.shape, np.int32)
    order = np.argsort(block, axis=0, kind="stable")
    np.put_along_axis(ranks, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    ordered = np.take_along_axis(block, order, axis=0)
    return ranks < n - depth, ranks >= depth, ordered[n - depth], ordered[depth - 1]


def nra_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, cfg: TopKConfig) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best candidates of every query in this block, best first, ties to the smaller id.

    Each dimension is a list sorted by value; a query with a positive weight reads it from the top, with a negative one
    from the bottom. After each step a candidate's score lies between the sum of what was read plus the worst and plus
    the best that the unread lists can add. A query whose k-th lower bound no outsider's upper bound reaches stops, and only
    those still in question get their final scores; a query that reads to the end has exact scores by then.
    `ids` must ascend.
    """
    n, k = len(ids), cfg.k
    top = float(np.abs(block).max(initial=0)) * float(np.abs(queries).max(initial=0)) * block.shape[1]
    kind = np.float32 if top < 2**24 else np.float64
    if top >= 2**53:
        kind = np.int64
    block, queries = block.astype(kind), queries.astype(kind)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    out: list[tuple[int, int, int]] = []
    waiting = np.arange(len(query_ids))
    at = np.searchsorted(ids, query_ids)
    own = np.where((at < n) & (ids[np.minimum(at, n - 1)] == query_ids), at, -1)

    def best(q: int, rows: np.ndarray, scores: np.ndarray) -> None:
        """Final scores of the candidates at `rows` (ascending): the k best, without the query's own row."""
        keep = rows != own[q]
        rows, scores = rows[keep], scores[keep].astype(np.int64)
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= least
            rows, scores = rows[near], scores[near]
        for i in np.lexsort((rows, -scores))[:k]:
            out.append((int(query_ids[q]), int(ids[rows[i]]), int(scores[i])))

    for share in cfg.depths:
        depth = int(n * share)
        if not len(waiting) or depth < k + 1:
            continue
        unread_up, unread_down, cur_top, cur_bottom = (x.astype(kind) for x in _shares(block, depth))
        u, d = up[waiting], down[waiting]
        read = u @ (block * (1 - unread_up)).T + d @ (block * (1 - unread_down)).T
        most = read + (u * cur_top) @ unread_up.T + (d * cur_bottom) @ unread_down.T
        read += (u * block.min(axis=0)) @ unread_up.T + (d * block.max(axis=0)) @ unread_down.T
        mine = own[waiting] >= 0
        read[np.flatnonzero(mine), own[waiting][mine]] = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
        floor = np.partition(read, n - k, axis=1)[:, n - k]
        open_ = most >= floor[:, None]
        few = open_.sum(axis=1) <= max(4 * k, n // 50)
        for j in np.flatnonzero(few):
            rows = np.flatnonzero(open_[j])
            best(waiting[j], rows, block[rows] @ queries[waiting[j]])
        waiting = waiting[~few]
    everyone = np.arange(n)
    for a in range(0, len(waiting), 256):
        scores = queries[waiting[a : a + 256]] @ block.T
        for j, q in enumerate(waiting[a : a + 256]):
            best(q, everyone, scores[j])
    return out


def _exact(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As `nra_block`, for components of any finite size. The sum of 64-bit products is right modulo 2**64, so it is the score wherever the
    score fits a long; a sum of doubles with its error bound tells that, and Python integers where it cannot. Other pairs are left out."""
    def wrapped(x: np.ndarray) -> np.ndarray:
        r = np.fmod(x, 2.0**64)
        return np.where(r >= 2.0**63, r - 2.0**64, np.where(r < -(2.0**63), r + 2.0**64, r)).astype(np.int64)

    out: list[tuple[int, int, int]] = []
    block, queries = block.astype(np.float64), queries.astype(np.float64)
    short_block, short_queries = wrapped(block), wrapped(queries)
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        scores = short_queries[a : a + 256] @ short_block.T
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.abs(part @ block.T)
            slack = (np.abs(part) @ np.abs(block).T) * (block.shape[1] + 2) * 2.0**-51
            fits, unsure = near + slack < 2.0**63, ~(near - slack > 2.0**63)
        for j, i in zip(*np.nonzero(unsure & ~fits)):
            score = sum(int(x) * int(y) for x, y in zip(part[j], block[i]))
            fits[j, i] = -(2**63) <= score < 2**63
        for j, q in enumerate(query_ids[a : a + 256]):
            rows = np.flatnonzero(fits[j] & (ids != q))
            # ~ turns the order of longs around without overflow
            for i in rows[np.lexsort((ids[rows], ~scores[j, rows]))[:k]]:
                out.append((int(q), int(ids[i]), int(scores[j, i])))
    return out


def best_pairs(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, cfg: TopKConfig) -> list[tuple[int, int, int]]:
    """(query, candidate, score) that hold the k best candidates of every query: bounds where all components are below LIMIT, exact
    64-bit sums for pairs with a larger one. A query may have k pairs from each."""
    big = lambda m: np.abs(m).max(axis=1, initial=0) >= LIMIT
    wide, asked_wide = big(block), big(queries)
    found: list[tuple[int, int, int]] = []
    if not wide.all() and not asked_wide.all():
        found = nra_block(ids[~wide], block[~wide], query_ids[~asked_wide], queries[~asked_wide], cfg)
    if wide.any() and not asked_wide.all():
        found += _exact(ids[wide], block[wide], query_ids[~asked_wide], queries[~asked_wide], cfg.k)
    if asked_wide.any():
        found += _exact(ids, block, query_ids[asked_wide], queries[asked_wide], cfg.k)
    return found


def quantised(vec: Column, scale: float) -> Column:
    """floor(scale * x) of every component as double; null for vectors that are null or hold a null or non-finite component. A component
    whose product with the scale is beyond all doubles is an error."""
    scaled = lambda x: x.cast("double") * scale
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y).otherwise(F.raise_error(F.lit("component too large to scale")).cast("double"))
    finite = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vec, lambda x: whole(scaled(x))))


def _own(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The place of each query's own row in the block whose ids ascend; -1 where it lies in another block."""
    low, high = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    out = np.full(len(query_ids), -1)
    for j in np.flatnonzero(low < high):
        same = np.flatnonzero((block[low[j] : high[j]] == queries[j]).all(axis=1))
        out[j] = low[j] + same[0] if len(same) else -1
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", is_query: Column | None = None, cfg: TopKConfig = TopKConfig()) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows: (query_id, rank, vec_id, score).

    Queries are the rows where `is_query` holds (default: id divisible by 50). Ties go to the smaller id; fewer candidates
    than k are all returned. Rows with a null id, or a vector that is null or holds a null or non-finite component, take no part; only
    vectors of equal length meet, empty ones too. Every row counts, also where ids repeat: a query row has all rows but itself as candidates,
    another row of its id and even its equal among them, and each of several query rows of one id has its own k results. A pair whose score
    does not fit a long has no row, as the score column cannot hold it. An empty table gives an empty result.

    Equal rows are worked on once, with their number. Candidates and queries are dealt into blocks by a hash, and every pair of blocks is
    one group of bounded size; k rows per query and block go on to the merge.
    """
    asked = F.col("id") % 50 == 0 if is_query is None else is_query
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), cfg.scale).alias("x")).filter("id is not null and x is not null")
    rows = written(rows.groupBy("id", "x").agg(F.count("*").alias("m")), "vectors")
    total, wanted = rows.agg(F.count("*"), F.count_if(asked)).first()
    n_blocks, n_asked = max(1, -(-total // cfg.block)), max(1, -(-wanted // cfg.queries))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim, key = F.size("x").alias("dim"), F.sha2(F.array_join(F.transform("x", lambda x: x.cast("string")), " "), 256).alias("key")
    candidates = rows.select("id", "x", "m", dim, F.pmod(F.xxhash64("id", "x"), F.lit(n_blocks)).cast("int").alias("cb"), numbers(n_asked).alias("qb"))
    queries = rows.filter(asked).select("id", "x", "m", key, dim, numbers(n_blocks).alias("cb"), F.pmod(F.xxhash64("id", "x", F.lit(1)), F.lit(n_asked)).cast("int").alias("qb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, of, score, copies = (np.empty(0, np.int64) for _ in range(4))
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.asarray(t["x"].combine_chunks().flatten()).reshape(t.num_rows, t["dim"][0].as_py())
            left = left.sort_by("id")
            block, asking, times = matrix(left), matrix(right), left["m"].to_numpy()
            own = _own(left["id"].to_numpy(), block, right["id"].to_numpy(), asking)
            # a row without an equal leaves itself out; one with equals meets all but one of them
            alone = (own >= 0) & (times[own] == 1)
            labels = np.where(alone, own, -1 - np.arange(len(own)))
            found = np.array(best_pairs(np.arange(len(block)), block, labels, asking, cfg), np.int64).reshape(-1, 3)
            query_of = dict(zip(labels.tolist(), range(len(labels))))
            of, at, score = np.array([query_of[q] for q in found[:, 0].tolist()], np.int64), found[:, 1], found[:, 2]
            ids, copies = left["id"].to_numpy()[at], times[at] - ((own[of] == at) & ~alone[of])
        picked = right.take(pa.array(of))
        return pa.table({"query_id": picked["id"], "key": picked["key"], "m": picked["m"], "vec_id": pa.array(ids), "score": pa.array(score), "copies": pa.array(copies)})

    keys = ["dim", "cb", "qb"]
    met = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, key string, m long, vec_id long, score long, copies long")
    # k rows a query and block
    w = Window.partitionBy("query_id", "key", "m").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("before", F.coalesce(F.sum("copies").over(w), F.lit(0))).filter(F.col("before") < cfg.k)
    ranks = F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("copies"), F.lit(cfg.k)).cast("int"))
    met = met.select("query_id", "m", "vec_id", "score", F.explode(ranks).alias("rank"))
    return met.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("col")
