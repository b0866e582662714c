"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the hash range is kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridra.llm.common import WordHash, release, shingle_hashes, slices, text_bytes, written

_LOWEST = -(2**63)


@dataclass(frozen=True)
class SketchConfig:
    """k words make a shingle; one hash in `scaled` is kept, whatever the document's length. A task gets about `range_bytes` of text."""

    k: int = 5
    scaled: int = 8
    range_bytes: int = 128 * 2**20


def _kept(hashes: np.ndarray, cfg: SketchConfig) -> np.ndarray:
    """Of ascending hashes those below the threshold, or the smallest alone where none is."""
    below = hashes[: np.searchsorted(hashes, 2**32 // cfg.scaled)]
    return below if len(below) else hashes[:1]


def sketch_text(text: str | None, cfg: SketchConfig, seen: WordHash) -> np.ndarray:
    """Sorted kept hashes, as 32 bits. Where none is below the threshold the smallest is kept, so only a text without words has none."""
    h = (shingle_hashes(text_bytes(text).lower().split(), cfg.k, seen) >> np.uint64(32)).astype(np.uint32)
    return np.unique(_kept(h, cfg))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the two sketches' hashes that both have; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's hashes that b has: how much of document a lies in b, however unequal their lengths. Of a text so short that only its
    smallest hash, above the threshold, is kept, this says nothing about longer ones."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(cfg: SketchConfig, *sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of the documents' shingles, exactly: a short part's hash above the threshold goes where another part has one below."""
    return _kept(np.unique(np.concatenate(sketches)), cfg)


def to_text(sketch: np.ndarray) -> str:
    """Eight hex digits a hash."""
    return _packed(sketch).hex()


def _packed(sketch: np.ndarray) -> bytes:
    """Four bytes a hash, as they are stored between jobs."""
    return sketch.astype(">u4").tobytes()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def _in_order(docs: DataFrame, id_col: str, text_col: str, cfg: SketchConfig) -> DataFrame:
    """(id, t) dealt by Spark's own range partitioning and sorted within each range. Rows of one id may lie in several ranges."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // cfg.range_bytes))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("ok"), F.xxhash64(text_col).alias("h"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.repartitionByRange(parts, "ok", "h").sortWithinPartitions("ok", "h").select("id", "t")


_MADE = [("doc_id", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.binary(), "binary"), ("edited_fingerprint", pa.binary(), "binary"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"), ("next_in_doc", pa.float64(), "double")]
#: a range's number, first and last text, on one row of each range; null on the others
_EDGE = [("slot", pa.int32(), "int"), ("first", pa.string(), "string"), ("last", pa.string(), "string")]


def _compared(doc: int | None, text: str, own: np.ndarray, after: str, following: np.ndarray, cfg: SketchConfig, seen: WordHash) -> tuple:
    """A document's row, given its sketch and its successor's text and sketch."""
    cut = len(text) // 4
    edited_text = text[: len(text) - cut] + after[:cut]
    edited = sketch_text(edited_text, cfg, seen)
    digest = hashlib.sha256(text_bytes(edited_text)).hexdigest()
    return doc, len(text), digest, _packed(own), _packed(edited), likeness(own, edited), likeness(own, following), containment(following, own)


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    parts = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(p, kind) for p, (_, kind, _) in zip(parts, columns)], names=[name for name, _, _ in columns])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare with the next document, one row per row:
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_in_doc).

    Edited: the last floor(n_chars / 4) code points give way to as many first ones (or all) of the next document by
    ascending id; after the last stands the first. Null text is empty; two texts without words have likeness 1. Repeated
    ids stand in the order of a hash of their texts, null ids first, and need not lie in one task. A single row is its own successor. An
    empty table gives no rows. Other columns are not looked at. The texts are shuffled once, by ranges of ids, a task each; the rows are written with
    each range's first and last text, and a join of those, two texts a range, gives the last row of every range its successor.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first, before = WordHash(), None, None
        for batch in batches:
            for piece in slices(batch, 500, 1, 1_000_000):
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in piece.columns)):
                    text = text or ""
                    own = sketch_text(text, cfg, seen)
                    if before:
                        rows.append((*_compared(*before, text, own, cfg, seen), None, None, None))
                    else:
                        first = text
                    before = (doc, text, own)
                yield _batch(rows, _MADE + _EDGE)
        if before:
            yield _batch([(before[0], *[None] * (len(_MADE) - 1), TaskContext.get().partitionId(), first, before[1])], _MADE + _EDGE)
        seen.clear()
        release()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            for piece in slices(batch, 100, 1, 1_000_000):
                rows = zip(*(c.to_pylist() for c in piece.columns))
                yield _batch([_compared(doc, text, sketch_text(text, cfg, seen), after, sketch_text(after, cfg, seen), cfg, seen) for doc, text, after in rows], _MADE)
        seen.clear()
        release()

    schema = lambda columns: ", ".join(f"{name} {kind}" for name, _, kind in columns)
    made = written(_in_order(docs, id_col, text_col, cfg).mapInArrow(within, schema(_MADE + _EDGE)), "fingerprints")
    edges = made.filter("slot is not null")
    # the ranges' numbers alone pass through one task
    order = Window.orderBy("slot")
    turns = edges.select("slot", F.coalesce(F.lead("slot").over(order), F.first("slot").over(order)).alias("next"))
    heads = edges.select(F.col("slot").alias("next"), F.col("first").alias("after"))
    ends = edges.select("slot", "doc_id", "last").join(turns.hint("merge"), "slot").join(heads.hint("merge"), "next").select("doc_id", "last", "after")
    whole = made.filter("slot is null").select(*(name for name, _, _ in _MADE)).union(ends.mapInArrow(across, schema(_MADE)))
    return whole.select(*(F.lower(F.hex(name)).alias(name) if kind == "binary" else name for name, _, kind in _MADE))
