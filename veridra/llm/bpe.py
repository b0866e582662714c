"""Byte-level BPE over Arrow batches: the vocabulary's ranks as a `tokenizers` model, and back again."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from veridra.llm.common import fresh, list_column, release, slices

#: bytes of text that are worked on at a time
SIZE = 2_000_000
# a task has one core; more threads would only hold more memory
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(shown)))
    return table


class Codec:
    """One vocabulary: text -> ids, ids -> bytes. The codes of pieces are remembered in two generations: once the young one has more than
    `limit` pieces it becomes the old one and the old one goes. A piece that is met again is young again, so frequent ones stay."""

    limit = 60_000

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        chars = byte_characters()
        shown = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        # any two tokens that join to a third may merge, in the order of the third's rank
        merges = [
            (shown[token[:i]], shown[token[i:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(pattern)
        back = {c: b for b, c in chars.items()}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(map(back.__getitem__, shown[token]))
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, without special tokens."""
        cut = [self.pieces.findall(t) for t in texts]
        young, old, new = self.young, self.old, []
        for piece in set().union(*cut):
            if piece not in young:
                code = old.get(piece)
                if code is None:
                    new.append(piece)
                else:
                    young[piece] = code
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            for piece, code in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False)):
                young[piece] = np.array(code.ids, "<u4").tobytes()
        ids = [np.frombuffer(b"".join(map(young.__getitem__, pieces)), "<u4") for pieces in cut]
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes the ids stand for; a character that spans several tokens is whole again here."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, text: bytes) -> np.ndarray:
        """For each token the character in which its first byte lies. Tokens that split one character share it."""
        starts = np.cumsum([0, *(len(self.bytes_of[i]) for i in ids.tolist()[:-1])]) if len(ids) else np.empty(0, np.int64)
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead) - 1)[starts]


@lru_cache(maxsize=1)
def _codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


@contextmanager
def codec(ranks_path: str, pattern: str) -> Iterator[Codec]:
    """The worker process's codec; the pieces it remembers go when the task ends, as idle workers keep their memory."""
    c = _codec(ranks_path, pattern)
    try:
        yield c
    finally:
        c.forget()
        release()


def decode_text(parts: list[bytes]) -> list[str]:
    """Decoded chunks of one document as text; a character cut by a chunk border goes to the chunk that ends it."""
    out, rest = [], b""
    for i, part in enumerate(parts):
        data, cut = rest + part, 0
        if i < len(parts) - 1:
            for back in range(1, min(4, len(data) + 1)):
                if data[-back] & 0xC0 == 0xC0:
                    need = 2 if data[-back] < 0xE0 else 3 if data[-back] < 0xF0 else 4
                    cut = back if need > back else 0
                    break
                if data[-back] < 0x80:
                    break
        out.append(data[: len(data) - cut].decode("utf-8", "replace"))
        rest = data[len(data) - cut :]
    return out


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Add `ids` (array<int>) to every row, with `offsets` each token's first character (array<int>), and with `decoded` the bytes
    that the ids decode to (binary), as `bpe_decode` gives them, without a second pass through Python.

    Null text counts as empty and has no ids. Every other column stays; a column named like a result is replaced, unless it is the text:
    that is read first. Repeated rows get equal results, an empty table stays empty.
    """
    numbers = T.ArrayType(T.IntegerType())
    made = {"ids": numbers} | ({"offsets": numbers} if offsets else {}) | ({"decoded": T.BinaryType()} if decoded else {})
    own = fresh("text", docs.columns)
    kept = docs.withColumn(own, F.coalesce(F.col(text_col), F.lit(""))).drop(*made)
    schema = T.StructType([*kept.drop(own).schema, *(T.StructField(n, t) for n, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for batch in batches:
                for piece in slices(batch, 5000, batch.num_columns - 1, SIZE):
                    texts = piece.column(piece.num_columns - 1).to_pylist()
                    ids = c.encode(texts)
                    new = [list_column(ids, pa.int32())]
                    if offsets:
                        new.append(list_column([c.offsets(i, t.encode()) for i, t in zip(ids, texts)], pa.int32()))
                    if decoded:
                        new.append(pa.array([c.decode(i) for i in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *new], names=schema.names)

    return kept.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add `decoded` (binary), the bytes that `ids_col` stands for. Null ids give no bytes."""
    kept = df.drop("decoded")
    schema = T.StructType([*kept.schema, T.StructField("decoded", T.BinaryType())])
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for batch in batches:
                for piece in slices(batch, 1000):
                    out = [c.decode(np.array(ids or [], np.int64)) for ids in piece.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and report digests of both: (doc_id, n_tokens, ids_sha256,
    decoded_sha256, n_bytes). One row per row; null text is empty and has no ids. Repeated rows get equal rows, an empty table none; other
    columns are not looked at, whatever their names. Very long texts are worked on whole, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for batch in batches:
                for piece in slices(batch, 5000, 1, SIZE):
                    ids = c.encode([t or "" for t in piece.column(1).to_pylist()])
                    back = [c.decode(i) for i in ids]
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(0),
                            pa.array([len(i) for i in ids], pa.int64()),
                            pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                            pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                            pa.array([len(b) for b in back], pa.int64()),
                        ],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
