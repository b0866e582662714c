"""Regression trees grown level by level from histograms: gradient boosting with an l2 term, and forests over keyed Poisson draws of rows.

Rows are written once, every feature as a byte (the number of its bin). A level is one pass: each task adds up weights and gradients per (tree, node,
feature, bin) of its rows, tasks' sums are added up, and every node takes its best cut. What moves is histograms, never rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from veridra.operators.draws import draws, halves
from veridra.operators.encode import MISSING, dictionary
from veridra.operators.ranks import how, quantiles_by
from veridra.sources.workspace import stored

#: bytes of histograms of all tasks that the driver adds up itself; more are added up by tasks
SMALL = 32 << 20
#: bytes of one task's histograms in one pass; the trees of a forest are grown so many at a time
ROOM = 32 << 20
#: trees of a boosted model after which every row's prediction is written anew
REFRESH = 20
#: rows that a partition of the binned table has about
ROWS = 50_000
#: distinct rows of bins up to which a boosted model grows in one task: some hundred bytes each
ALONE = 10_000_000
#: cells of a grid that such a model may grow over instead, and how many times its rows they may be
GRID, SPARSE = 1 << 24, 8
#: distinct rows of bins whose predictions a task keeps
KNOWN = 1 << 18
#: combinations of bins that columns summed up together have at most
CELLS = 1 << 15
#: combinations of bins that columns looked up together have at most, levels of trees that are looked up so, and rows at a time
LOOKED_UP, LEVELS, AT_A_TIME = 1 << 12, 4, 1 << 11


@dataclass(frozen=True)
class Trees:
    """`trees` regression trees of at most `depth` levels over `bins` bins a feature; a leaf has `least` rows (draws) at least. Boosting adds each tree's
    leaves, shrunk by `rate`, to the ones before, and `l2` is added to the row count that a leaf's gradient is divided by. A forest is
    the mean of trees over Poisson draws of the rows."""

    trees: int
    depth: int
    boosting: bool
    rate: float = 1.0
    l2: float = 0.0
    least: int = 1
    bins: int = 64
    seed: int = 42

    # the names under which pyspark.ml has these numbers
    def getNumTrees(self) -> int:  # noqa: N802
        return self.trees

    def getMaxIter(self) -> int:  # noqa: N802
        return self.trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.depth


@dataclass
class Grown:
    """Trees as arrays (tree, node); node i has the children 2i + 1 and 2i + 2. `feature` is -1 at leaves; bins up to `cut` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Grown:
        shape = (trees, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape))

    def node(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has come to after some levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[tree][at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.cut[tree][at]), at)
        return at

    def values(self, tree: int, columns: np.ndarray) -> np.ndarray:
        """What the tree gives for each row, its bins as `columns`. Nodes near the root are tried for all rows at a time, those below by the node that a row is in."""
        n, depth = columns.shape[1], (self.value.shape[1] + 1).bit_length() - 2
        feature, cut, value = self.feature[tree], self.cut[tree], self.value[tree].copy()
        for node in range(len(value) // 2):
            if feature[node] < 0:
                value[2 * node + 1 : 2 * node + 3] = value[node]
        at, rows = np.zeros(n, np.int64), np.arange(n)
        for level in range(depth):
            base, right = 2**level - 1, np.zeros(n, bool)
            if level < 4:
                for i in np.flatnonzero(feature[base : 2 * base + 1] >= 0).tolist():
                    right |= (columns[feature[base + i]] > cut[base + i]) & (at == i)
            else:
                f = feature[base + at]
                right = (columns[f, rows] > cut[base + at]) & (f >= 0)
            at = 2 * at + right
        return value[2**depth - 1 + at]

    def sums(self, bins: np.ndarray, sizes: list[int]) -> np.ndarray:
        """What all trees together give for each row of bins. A bin leaves some leaves of a tree within reach, as bits; those that all of a row's bins leave, looked up for
        some columns at a time, begin with the row's leaf."""
        trees, depth = len(self.value), (self.value.shape[1] + 1).bit_length() - 2
        if depth > LEVELS:
            turned = np.ascontiguousarray(bins.T)
            return sum((self.values(t, turned) for t in range(trees)), np.zeros(len(bins)))
        leaves, value = 2**depth, self.value.copy()
        reach = {}
        for node in range(leaves - 1):
            level = (node + 1).bit_length() - 1
            wide = leaves >> level
            at = (node + 1 - 2**level) * wide
            sides = [sum(1 << leaf for leaf in range(a, a + wide // 2)) for a in (at, at + wide // 2)]
            whole = self.feature[:, node] < 0
            value[whole, 2 * node + 1] = value[whole, 2 * node + 2] = value[whole, node]
            for t in np.flatnonzero(~whole).tolist():
                f, cut = int(self.feature[t, node]), int(self.cut[t, node])
                table = reach.setdefault(f, np.full((sizes[f], trees), 0xFFFF, np.uint16))
                table[: cut + 1, t] &= np.uint16(0xFFFF ^ sides[1])
                table[cut + 1 :, t] &= np.uint16(0xFFFF ^ sides[0])
        groups: list[tuple[list[int], np.ndarray]] = []
        for f in sorted(reach):
            if groups and len(groups[-1][1]) * sizes[f] <= LOOKED_UP:
                columns, table = groups[-1]
                groups[-1] = [*columns, f], (table[:, None] & reach[f]).reshape(-1, trees)
            else:
                groups.append(([f], reach[f]))
        # the place of the lowest bit, for numbers that have one bit
        place = np.zeros(1 << 16, np.int32)
        place[1 << np.arange(16)] = np.arange(16)
        flat, first, out = value[:, leaves - 1 :].ravel(), np.arange(trees, dtype=np.int32) * leaves, np.zeros(len(bins))
        for a in range(0, len(bins), AT_A_TIME):
            part = bins[a : a + AT_A_TIME]
            left = np.full((len(part), trees), 0xFFFF, np.uint16)
            for columns, table in groups:
                left &= table[_codes(part[:, columns], [sizes[c] for c in columns])]
            out[a : a + AT_A_TIME] = flat[place[left & (~left + np.uint16(1))] + first].sum(axis=1)
        return out

    def some(self, trees: slice) -> Grown:
        return Grown(self.feature[trees], self.cut[trees], self.value[trees])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Binary values of d bytes each as rows of bytes."""
    n, offset = len(column), column.offset
    at = np.frombuffer(column.buffers()[1], np.int32, n + 1, offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(n, d) if n else np.zeros((0, d), np.uint8)


def bin_cuts(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts per numeric feature: values up to the i-th cut are in bin i at most. All values but the largest are cuts where there are no more
    than `bins`, else exact quantiles. Nulls count as smaller than all numbers."""
    numbers = train.select(*(F.col(c).cast("double").alias(c) for c in features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch's distinct values, before anything is written or compared with other batches'
        for batch in batches:
            for c, column in zip(features, batch.columns):
                v = pc.drop_null(pc.unique(column))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.string()), v], ["feature", "v"])

    values = stored(numbers.mapInArrow(run, "feature string, v double").distinct(), "values")
    distinct = {r.feature: r.n for r in values.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # a row per feature
    few = [c for c in features if distinct.get(c, 0) <= bins]
    cuts = {c: np.empty(0) for c in features}
    for r in values.filter(F.col("feature").isin(few)).groupBy("feature").agg(F.array_sort(F.collect_list("v")).alias("v")).collect():  # `bins` values a feature at most
        cuts[r.feature] = np.array(r.v[:-1])
    if len(few) < len(features):
        qs = {f"q{i}": i / bins for i in range(1, bins)}
        many = [c for c in features if c not in few]
        for r in quantiles_by(stored(numbers.select(*many).unpivot([], many, "feature", "v").filter("v is not null")), ["feature"], "v", qs).collect():
            cuts[r.feature] = np.unique([r[q] for q in qs])
    return [cuts[c] for c in features]


def binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """(keep..., bins): each row's bins as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(features)
        for batch in batches:
            out = np.zeros((batch.num_rows, d), np.uint8)
            for k in range(d):
                v = batch.column(k).to_numpy(zero_copy_only=False)
                out[:, k] = np.where(np.isnan(v), 0, np.searchsorted(cuts[k], v))
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d)
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at.buffers()[1], pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[d:], made], names=[*keep, "bins"])

    rows = rows.select(*(F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(features)), *keep)
    return rows.mapInArrow(run, rows.select(*keep).withColumn("bins", F.lit(b"")).schema)


def _summed(rows: DataFrame, parts: int, trees: int, size: int, run) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, sums) over all of `parts` tasks; `run` gives a task's rows (tree, part, s array<double>) of `size` numbers. Histograms of few tasks are
    added up on the driver, of many in rounds of 64 tasks' first."""
    kind = "tree int, part int, s array<double>"
    made = rows.mapInArrow(run, kind)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for s in table["s"].chunks:
            total += s.flatten().to_numpy().reshape(len(s), size).sum(axis=0)
        return pa.table({"tree": [table["tree"][0].as_py()], "part": [table["part"][0].as_py()], "s": pa.array([total], pa.list_(pa.float64()))}, pa.schema([("tree", pa.int32()), ("part", pa.int32()), ("s", pa.list_(pa.float64()))]))

    while parts * trees * size * 8 > SMALL and parts > 1:
        parts = -(-parts // 64)
        made = made.withColumn("part", F.col("part") % parts).groupBy("tree", "part").applyInArrow(add, kind)
    total: dict[int, np.ndarray] = {}
    for batch in made.toArrow().to_batches():
        trees, lists = batch["tree"].to_pylist(), batch["s"].flatten().to_numpy().reshape(batch.num_rows, -1)
        for t, s in zip(trees, lists):
            total[t] = total[t] + s if t in total else s
    yield from total.items()


def _split(grown: Grown, tree: int, level: int, sums: np.ndarray, d: int, cfg: Trees) -> int:
    """Give the nodes of a level their best cuts and their children their values; how many were split. `sums` is (2, nodes, feature, bin) of
    weights and gradients. Equal gains go to the first feature, then the lowest cut."""
    base = 2**level - 1
    w, g = sums.reshape(2, 2**level, d, cfg.bins)
    total_w, total_g = w[:, 0].sum(axis=1), g[:, 0].sum(axis=1)
    if level == 0:
        grown.value[tree, 0] = total_g[0] / (total_w[0] + cfg.l2) if total_w[0] else 0.0
    left_w, left_g = (x.cumsum(axis=2)[:, :, :-1] for x in (w, g))
    right_w, right_g = total_w[:, None, None] - left_w, total_g[:, None, None] - left_g
    fits = (left_w >= max(cfg.least, 1)) & (right_w >= max(cfg.least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda gs, ws: np.where(ws + cfg.l2 > 0, gs * gs / (ws + cfg.l2), 0.0)
        own = score(total_g, total_w)
        gain = np.where(fits, score(left_g, left_w) + score(right_g, right_w) - own[:, None, None], -np.inf).reshape(2**level, -1)
    best = gain.argmax(axis=1)
    top = gain[np.arange(2**level), best]
    # what rounding alone may give is no gain
    found = np.flatnonzero(top > 1e-10 * np.maximum(own, 1e-300))
    for i in found.tolist():
        f, b = divmod(int(best[i]), cfg.bins - 1)
        grown.feature[tree, base + i], grown.cut[tree, base + i] = f, b
        child = 2 * (base + i) + 1
        grown.value[tree, child] = left_g[i, f, b] / (left_w[i, f, b] + cfg.l2)
        grown.value[tree, child + 1] = right_g[i, f, b] / (right_w[i, f, b] + cfg.l2)
    return len(found)


def _histogram(bins: np.ndarray, node: np.ndarray, w: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    """(weights, gradients) per node of the level, feature and bin, flat."""
    here = np.flatnonzero((node >= 2**level - 1) & (w > 0))
    d = bins.shape[1]
    at = (((node[here] - 2**level + 1)[:, None] * d + np.arange(d)) * size + bins[here]).ravel()
    n = 2**level * d * size
    return np.concatenate([np.bincount(at, weights=np.repeat(x[here], d), minlength=n) for x in (w, g)])


def _boost(rows: DataFrame, at: list[list[int]], cfg: Trees) -> list[Grown]:
    """Models over some of the bins' places each, grown in step: a pass over the rows gives the next level of every model's tree. Rows are (bins, n, y, f): how many
    rows have these bins, the sum of their labels about the mean, and each model's prediction so far."""
    rows = _wide(rows)
    grown, spark, written, parts = [Grown.empty(cfg.trees, cfg.depth) for _ in at], rows.sparkSession, 0, rows.rdd.getNumPartitions()
    for tree in range(cfg.trees):
        if tree - written >= REFRESH:
            rows, written = _wide(stored(_added(rows, grown, written, tree, at, cfg), "boosted")), tree
            parts = rows.rdd.getNumPartitions()
        live = list(range(len(at)))
        for level in range(cfg.depth):
            sent = spark.sparkContext.broadcast([g.some(slice(written, tree + 1)) for g in grown])
            sizes = [2 * 2**level * len(places) * cfg.bins for places in at]
            size = max(sizes[k] for k in live)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = {k: np.zeros(size) for k in live}  # noqa: B023
                for batch in batches:
                    every, n, y, f = _columns(batch)
                    for k, sums in total.items():
                        trees, bins, own = sent.value[k], every[:, at[k]], f[:, k]  # noqa: B023
                        turned = np.ascontiguousarray(bins.T)
                        for t in range(len(trees.value) - 1):
                            own = own + cfg.rate * trees.values(t, turned)
                        node = trees.node(len(trees.value) - 1, bins, level)  # noqa: B023
                        sums[: sizes[k]] += _histogram(bins, node, n, y - n * own, level, cfg.bins)  # noqa: B023
                for k, sums in total.items():
                    yield _row(k, sums)

            live = sorted(k for k, sums in _summed(rows, parts, len(live), size, run) if _split(grown[k], tree, level, sums[: sizes[k]], len(at[k]), cfg))
            sent.destroy()
            if not live:
                break
    return grown


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, n, y, f) as arrays; f has a column per model."""
    n, y = (c.to_numpy() for c in batch.columns[1:3])
    places = len(batch.column(0)[0].as_py()) if batch.num_rows else 0
    return _matrix(batch.column(0), places), n, y, batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _blocks(bins: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of columns that have CELLS combinations of bins at most (or one column), each as (first column, every row's combination, the combinations). Sums over
    rows are taken per combination, and those of single bins from them."""
    out, d = [], bins.shape[1]
    first = 0
    while first < d:
        code, cells = np.zeros(len(bins), np.int32), 1
        for c in range(first, d):
            finer = code * np.int32(int(bins[:, c].max(initial=0)) + 1) + bins[:, c]
            there = np.bincount(finer) > 0
            if c > first and there.sum() > CELLS:
                break
            code, cells = (np.cumsum(there, dtype=np.int32) - 1)[finer], int(there.sum())
            last = c
        table = np.zeros((cells, last + 1 - first), np.uint8)
        table[code] = bins[:, first : last + 1]
        out.append((first, code, table))
        first = last + 1
    return out


def _single(table: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(places among all columns' bins that occur, a 1 for each combination's bin of every column)."""
    used = [np.unique(column) for column in table.T]
    return np.concatenate([c * bins + u.astype(np.int64) for c, u in enumerate(used)]), np.hstack([(column[:, None] == u).astype(np.float64) for column, u in zip(table.T, used)])


def _grown_in_grid(blocks: list[tuple[int, np.ndarray, np.ndarray]], n: np.ndarray, y: np.ndarray, d: int, cfg: Trees) -> Grown:
    """The same as `_grown_alone` over the grid of two blocks' combinations. Each cut looks at one block, so a node is some combinations of the one with some of the other, and its
    sums per combination are products of the grid with vectors of 0 and 1: a cell costs much less than a row."""
    grown, tables, firsts = Grown.empty(cfg.trees, cfg.depth), [b[2] for b in blocks], [b[0] for b in blocks]
    shape = len(tables[0]), len(tables[1])
    key = blocks[0][1].astype(np.int64) * shape[1] + blocks[1][1]
    n, g = (np.bincount(key, weights=x, minlength=shape[0] * shape[1]).reshape(shape) for x in (n, y))
    single = [_single(table, cfg.bins) for table in tables]
    rows = max(1, (1 << 18) // shape[1])
    for tree in range(cfg.trees):
        # per block, the combinations that each node has, and sums of weights and gradients over its combinations of the other block
        inside, value = [np.ones((1, k)) for k in shape], grown.value[tree, :1]
        over = [np.stack([x.sum(axis=1 - s)[None] for x in (n, g)]) for s in (0, 1)]
        for level in range(cfg.depth):
            base, nodes = 2**level - 1, 2**level
            sums = np.zeros((2, nodes, d, cfg.bins))
            for first, table, (used, one), mine, own in zip(firsts, tables, single, inside, over):
                found = np.zeros((2, nodes, table.shape[1] * cfg.bins))
                found[:, :, used] = (own * mine) @ one
                sums[:, :, first : first + table.shape[1]] = found.reshape(2, nodes, -1, cfg.bins)
            if level:
                # nodes below one that was not split hold nothing
                sums[:, np.repeat(grown.feature[tree, (base - 1) // 2 : base] < 0, 2)] = 0
            split = _split(grown, tree, level, sums, d, cfg)
            if not level:
                value = grown.value[tree, :1]
            if not split:
                break
            feature, cut = grown.feature[tree, base : base + nodes], grown.cut[tree, base : base + nodes]
            side = (feature >= firsts[1]).astype(int)
            below = [np.repeat(x, 2, axis=0) for x in inside]
            for k in range(nodes):
                s = side[k]
                goes = tables[s][:, feature[k] - firsts[s]] > cut[k] if feature[k] >= 0 else np.zeros(shape[s], bool)
                below[s][2 * k] *= ~goes
                below[s][2 * k + 1] *= goes
            value = np.where(np.repeat(feature >= 0, 2), grown.value[tree, 2 * base + 1 : 2 * base + 1 + 2 * nodes], np.repeat(value, 2))
            inside = below
            if level == cfg.depth - 1:
                break
            over = [np.repeat(x, 2, axis=1) for x in over]
            for s in (0, 1):
                # a cut of one block leaves the sums over the other block as they are
                at = np.flatnonzero((side == s) & (feature >= 0))
                if len(at):
                    low = inside[s][2 * at]
                    left = np.stack([low @ (x if s == 0 else x.T) for x in (n, g)])
                    over[1 - s][:, 2 * at], over[1 - s][:, 2 * at + 1] = left, over[1 - s][:, 2 * at] - left
        given = (inside[0] * (cfg.rate * value)[:, None]).T
        for a in range(0, shape[0], rows):
            g[a : a + rows] -= n[a : a + rows] * (given[a : a + rows] @ inside[1])
    return grown


def _grown_alone(blocks: list[tuple[int, np.ndarray, np.ndarray]], n: np.ndarray, y: np.ndarray, d: int, cfg: Trees) -> Grown:
    """All trees of a boosted model over `blocks` of d columns in all: a row costs some steps per block and level, however many columns there are."""
    if len(blocks) == 2 and len(blocks[0][2]) * len(blocks[1][2]) <= min(GRID, SPARSE * len(n)):
        return _grown_in_grid(blocks, n, y, d, cfg)
    grown, f = Grown.empty(cfg.trees, cfg.depth), np.zeros(len(n))
    single = [_single(table, cfg.bins) for _, _, table in blocks]
    for tree in range(cfg.trees):
        g, node, value = y - n * f, np.zeros(len(n), np.int32), grown.value[tree, :1]
        for level in range(cfg.depth):
            base, nodes = 2**level - 1, 2**level
            sums, at = np.zeros((2, nodes, d, cfg.bins)), []
            for (first, code, table), (used, one) in zip(blocks, single):
                at.append(node * np.int32(len(table)) + code)
                for w, total in zip((n, g), sums):
                    cells = np.bincount(at[-1], weights=w, minlength=nodes * len(table)).reshape(nodes, -1)
                    own = np.zeros((nodes, table.shape[1] * cfg.bins))
                    own[:, used] = cells @ one
                    total[:, first : first + table.shape[1]] = own.reshape(nodes, -1, cfg.bins)
            if level:
                # nodes below one that was not split hold nothing
                sums[:, np.repeat(grown.feature[tree, (base - 1) // 2 : base] < 0, 2)] = 0
            found = _split(grown, tree, level, sums, d, cfg)
            if not level:
                value = grown.value[tree, :1]
            if not found:
                break
            feature, cut = grown.feature[tree, base : base + nodes], grown.cut[tree, base : base + nodes]
            right = np.zeros(len(n), bool)
            for (first, _, table), keys in zip(blocks, at):
                mine = (feature >= first) & (feature < first + table.shape[1])
                goes = mine[:, None] & (table.T[np.where(mine, feature - first, 0)] > cut[:, None])
                right |= goes.ravel()[keys]
            node = 2 * node + right
            value = np.where(np.repeat(feature >= 0, 2), grown.value[tree, 2 * base + 1 : 2 * base + 1 + 2 * nodes], np.repeat(value, 2))
        f += cfg.rate * value[node]
    return grown


def _boost_alone(rows: DataFrame, at: list[list[int]], cfg: Trees) -> list[Grown]:
    """The same for models of ALONE distinct rows of bins at most, whatever the number of rows behind them, given as (model, bins, n, y): no histogram has to wait for
    another task's, so each model has a task that goes through all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        k = parts[0].column(0)[0].as_py()
        bins = np.concatenate([_matrix(b.column(1), len(at[k])) for b in parts])
        n, y = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in (2, 3))
        del parts
        blocks = _blocks(bins)
        del bins
        grown = _grown_alone(blocks, n, y, len(at[k]), cfg)
        flat = [pa.array([x.ravel()], pa.list_(t)) for x, t in ((grown.feature, pa.int64()), (grown.cut, pa.int64()), (grown.value, pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *flat], ["model", "feature", "cut", "value"])

    # a partition a model, in a fixed order
    dealt = rows.repartitionById(len(at), F.col("model")).sortWithinPartitions("bins")
    made = dealt.mapInArrow(run, "model int, feature array<long>, cut array<long>, value array<double>").toArrow()
    out = [Grown.empty(cfg.trees, cfg.depth) for _ in at]
    for i, k in enumerate(made["model"].to_pylist()):
        out[k] = Grown(*(made[c][i].values.to_numpy().reshape(cfg.trees, -1).copy() for c in ("feature", "cut", "value")))
    return out


def _row(tree: int, total: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["tree", "part", "s"])


def _added(rows: DataFrame, grown: list[Grown], begin: int, end: int, at: list[list[int]], cfg: Trees) -> DataFrame:
    """The rows with the predictions of some more trees of each model in f."""
    more = [g.some(slice(begin, end)) for g in grown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            every, _, _, f = _columns(batch)
            f = f.copy()
            for k, trees in enumerate(more):
                turned = np.ascontiguousarray(every[:, at[k]].T)
                for t in range(len(trees.value)):
                    f[:, k] += cfg.rate * trees.values(t, turned)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(more)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _codes(bins: np.ndarray, sizes: list[int]) -> np.ndarray:
    """One number per row that stands for its bins, given how many bins every column has."""
    code = np.zeros(len(bins), np.int64)
    for column, size in zip(bins.T, sizes):
        code = code * size + column
    return code


def _countable(sizes: list[int]) -> bool:
    return math.prod(sizes) < 2**62


def _wide(rows: DataFrame) -> DataFrame:
    """The rows in no more tasks than keep the cluster busy, as every task sends sums of one size, however many rows it has."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _forest_of_cells(rows: DataFrame, table: np.ndarray, sizes: list[int], cfg: Trees) -> Grown:
    """The same where rows have few distinct bins, the rows of `table`: one pass adds up every tree's draws and labels per distinct row, and trees grow over those sums."""
    grown, d, order = Grown.empty(cfg.trees, cfg.depth), table.shape[1], np.argsort(_codes(table, sizes))
    table = table[order]
    known, rows = _codes(table, sizes), _wide(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cfg.trees, 2, len(known)))
        for batch in batches:
            bins, _, y, high, low = _matrix(batch.column(0), d), *(c.to_numpy() for c in batch.columns[1:])
            at = np.searchsorted(known, _codes(bins, sizes))
            for t in range(cfg.trees):
                (drawn,) = draws(cfg.seed, np.array([t]), high, low)
                for sums, w in zip(total[t], (drawn, drawn * y)):
                    sums += np.bincount(at, weights=w, minlength=len(known))
        for t in range(cfg.trees):
            yield _row(t, total[t].ravel())

    for tree, sums in _summed(rows, rows.rdd.getNumPartitions(), cfg.trees, 2 * len(known), run):
        w, g = sums.reshape(2, -1)
        for level in range(cfg.depth):
            if not _split(grown, tree, level, _histogram(table, grown.node(tree, table, level), w, g, level, cfg.bins), d, cfg):
                break
    return grown


def _forest(rows: DataFrame, d: int, cfg: Trees) -> Grown:
    """Rows are (bins, n, y, high, low): label about the mean, and the halves of the row's key, by which each tree draws it."""
    rows = _wide(rows)
    grown, spark, parts = Grown.empty(cfg.trees, cfg.depth), rows.sparkSession, rows.rdd.getNumPartitions()
    live = set(range(cfg.trees))
    for level in range(cfg.depth):
        size = 2 * 2**level * d * cfg.bins
        at_once = max(1, ROOM // (size * 8))
        todo = sorted(live)
        for at in range(0, len(todo), at_once):
            group = todo[at : at + at_once]
            sent = spark.sparkContext.broadcast(Grown(grown.feature[group], grown.cut[group], grown.value[group]))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trees, total = sent.value, np.zeros((len(group), size))  # noqa: B023
                for batch in batches:
                    bins, _, y, high, low = _matrix(batch.column(0), d), *(c.to_numpy() for c in batch.columns[1:])
                    drawn = draws(cfg.seed, np.array(group), high, low)  # noqa: B023
                    for t in range(len(group)):  # noqa: B023
                        total[t] += _histogram(bins, trees.node(t, bins, level), drawn[t], drawn[t] * y, level, cfg.bins)  # noqa: B023
                for t, tree in enumerate(group):  # noqa: B023
                    yield _row(tree, total[t])

            for tree, sums in _summed(rows, parts, len(group), size, run):
                if not _split(grown, tree, level, sums, d, cfg):
                    live.discard(tree)
            sent.destroy()
    return grown


@dataclass
class TreeModel:
    features: list[str]
    cuts: list[np.ndarray]
    grown: Grown
    mean: float
    cfg: Trees

    def predict(self, rows: DataFrame, keep: list[str], out: str = "predicted") -> DataFrame:
        """(keep..., out) of every row."""
        if not self.features:
            return rows.select(*keep, F.lit(self.mean).alias(out))
        scores, d = self.scorer(), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = scores()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score(_matrix(batch.column(batch.num_columns - 1), d)))], [*keep, out])

        made = binned(rows, self.features, self.cuts, keep)
        return made.mapInArrow(run, made.drop("bins").withColumn(out, F.lit(0.0)).schema)

    def scorer(self) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
        """What makes, in a task, a function from rows of bins to predictions."""
        grown, mean, cfg, d = self.grown, self.mean, self.cfg, len(self.features)
        weight, sizes = cfg.rate if cfg.boosting else 1.0 / cfg.trees, [len(c) + 1 for c in self.cuts]

        def make() -> Callable[[np.ndarray], np.ndarray]:
            # predictions of distinct bins that the task has met
            known, found = np.zeros(0, np.int64), np.zeros(0)

            def score(bins: np.ndarray) -> np.ndarray:
                nonlocal known, found
                if not d:
                    return np.full(len(bins), mean)
                if not _countable(sizes):
                    return mean + weight * grown.sums(bins, sizes)
                codes, first, where = np.unique(_codes(bins, sizes), return_index=True, return_inverse=True)
                at = np.searchsorted(known, codes)
                have = at < len(known)
                have[have] = known[at[have]] == codes[have]
                new = np.zeros(len(codes))
                new[have] = found[at[have]]
                new[~have] = mean + weight * grown.sums(bins[first[~have]], sizes)
                if len(known) < KNOWN:
                    known, found = np.insert(known, at[~have], codes[~have]), np.insert(found, at[~have], new[~have])
                return new[where]

            return score

        return make


def predict_sets(rows: DataFrame, models: Mapping[str, TreeModel], keep: list[str]) -> DataFrame:
    """Long predictions (keep..., setting, predicted) of models that share their features' cuts (as those of `fit_boosted`), in one pass: a row's bins are found once."""
    cuts = {c: cut for m in models.values() for c, cut in zip(m.features, m.cuts)}
    features = list(cuts)
    scorers = [(m.scorer(), [features.index(c) for c in m.features]) for m in models.values()]
    d, k = len(features), len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [(make(), at) for make, at in scorers]
        for batch in batches:
            bins = _matrix(batch.column(batch.num_columns - 1), d)
            out = np.column_stack([score(bins[:, at]) for score, at in scores])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * k), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keep, "_p"])

    made = binned(rows, features, [cuts[c] for c in features], keep)
    scored = made.mapInArrow(run, made.drop("bins").withColumn("_p", F.array().cast("array<double>")).schema)
    return scored.select(*keep, F.posexplode("_p").alias("_k", "predicted")).withColumn("setting", F.element_at(F.array(*map(F.lit, models)), F.col("_k") + 1)).drop("_k")


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Places that follow one another, as (from, to)."""
    out: list[tuple[int, int]] = []
    for i in places:
        out = [*out[:-1], (out[-1][0], i + 1)] if out and out[-1][1] == i else [*out, (i, i + 1)]
    return out


def fit_trees(train: DataFrame, features: list[str], y: str, keys: list[str], cfg: Trees) -> TreeModel:
    """Grow trees over numeric features. Rows with a null label take no part; `keys` name a row, for the draws. `train` is read several times; give
    it stored."""
    if cfg.boosting:
        return fit_boosted(train, {"": features}, y, cfg)[""]
    train = train.filter(F.col(y).isNotNull())
    cuts = bin_cuts(train, features, cfg.bins)
    n, mean = train.agg(F.count("*"), F.avg(F.col(y).cast("double"))).first()
    mean = mean or 0.0
    own = [(F.col(y).cast("double") - mean).alias("_y"), *(h.alias(a) for h, a in zip(halves(*(F.col(k) for k in keys)), ("_high", "_low")))]
    rows = binned(train.select(*features, *own), features, cuts, ["_y", "_high", "_low"])
    rows = rows.select("bins", F.lit(1.0).alias("n"), F.col("_y").alias("y"), F.col("_high").alias("high"), F.col("_low").alias("low"))
    # in a fixed order, so that sums are the same to the last bit in every run
    rows = stored(rows.repartition(max(1, -(-n // ROWS))).sortWithinPartitions(*rows.columns), "binned")
    if not n:
        return TreeModel(features, cuts, Grown.empty(cfg.trees, cfg.depth), mean, cfg)
    sizes = [len(c) + 1 for c in cuts]
    cells = rows.select("bins").distinct().limit(CELLS + 1).toArrow().combine_chunks() if _countable(sizes) else None
    if cells is None or len(cells) > CELLS:
        return TreeModel(features, cuts, _forest(rows, len(features), cfg), mean, cfg)
    table = np.frombuffer(b"".join(cells["bins"].to_pylist()), np.uint8).reshape(-1, len(features))
    return TreeModel(features, cuts, _forest_of_cells(rows, table, sizes, cfg), mean, cfg)


def fit_boosted(train: DataFrame, sets: Mapping[str, list[str]], y: str, cfg: Trees) -> dict[str, TreeModel]:
    """A boosted model per named set of numeric features; a set without features is the mean. Rows with a null label take no part. All sets share one table of bins. Rows
    that have the same bins in a set are one row with their number and sum, which is exact for squared errors. Models of ALONE such rows at most grow in
    a task each, all at once; the others in step, a level of all of them in one pass. `train` is read several times; give it stored."""
    features = list(dict.fromkeys(c for s in sets.values() for c in s))
    train = train.filter(F.col(y).isNotNull())
    cuts = dict(zip(features, bin_cuts(train, features, cfg.bins) if features else []))
    n, mean = train.agg(F.count("*"), F.avg(F.col(y).cast("double"))).first()
    mean = mean or 0.0
    grown = {s: Grown.empty(cfg.trees, cfg.depth) for s in sets}
    places = {s: [features.index(c) for c in own] for s, own in sets.items() if own}
    if n and places:
        rows = binned(train.select(*features, (F.col(y).cast("double") - mean).alias("_y")), features, [cuts[c] for c in features], ["_y"])
        rows = stored(rows.groupBy("bins").agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("y")), "binned")
        alone, together = {}, {}
        for s, at in places.items():
            part = rows
            if at != list(range(len(features))):
                part = rows.groupBy(F.concat(*(F.substring("bins", a + 1, b - a) for a, b in _runs(at))).alias("bins")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
                part = stored(part, "binned")
            (alone if part.count() <= ALONE else together)[s] = part
        if alone:
            marked = [part.select(F.lit(k).alias("model"), "bins", "n", "y") for k, part in enumerate(alone.values())]
            grown |= zip(alone, _boost_alone(reduce(DataFrame.union, marked), [places[s] for s in alone], cfg))
        if together:
            rows = rows.withColumn("f", F.array_repeat(F.lit(0.0), len(together)))
            # in a fixed order, so that sums are the same to the last bit in every run
            rows = stored(rows.repartition(max(1, -(-rows.count() // ROWS))).sortWithinPartitions("bins"), "binned")
            grown |= zip(together, _boost(rows, [places[s] for s in together], cfg))
    return {s: TreeModel(own, [cuts[c] for c in own], grown[s], mean, cfg) for s, own in sets.items()}


def tree_columns(train: DataFrame, rows: DataFrame, features: list[str], most: int = 32) -> tuple[DataFrame, list[str]]:
    """The rows with a numeric column for every feature, and those columns' names. Text columns of at most `most` categories in `train` become one 0/1
    column a category; others their place in the dictionary (frequent ones first), unknown ones null."""
    kinds = dict(train.dtypes)
    names = [c for c in features if kinds[c] != "string"]
    text = [c for c in features if kinds[c] == "string"]
    if not text:
        return rows, names
    words = stored(dictionary(train, text), "dictionary")
    hint = how(words)
    for c in text:
        own = words.filter(F.col("feature") == c)
        few: list[Row] = own.orderBy("place").limit(most + 1).collect()
        if len(few) <= most:
            made = {f"{c}={r.category}": (F.coalesce(F.col(c), F.lit(MISSING)) == r.category).cast("double") for r in few}
            rows, names = rows.withColumns({f"_{c}_{i}": v for i, v in enumerate(made.values())}), [*names, *(f"_{c}_{i}" for i in range(len(made)))]
        else:
            place = own.select(F.col("category").alias("_word"), F.col("place").cast("double").alias(f"_{c}_place")).hint(hint)
            rows = rows.join(place, F.coalesce(F.col(c), F.lit(MISSING)) == F.col("_word"), "left").drop("_word")
            names.append(f"_{c}_place")
    return rows, names
