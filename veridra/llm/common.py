"""Helpers shared by the text operators: work folders and word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_P1, _P2, _P3 = U64(0x9E3779B97F4A7C15), U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def work_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names, else the context's checkpoint folder. Where neither is set a local session
    (as in tests) gets a temporary one; on a cluster that is an error, as executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veridra-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors,
    and gives later joins a size that is measured, not guessed."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered for up to `limit` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> U64(33))
    x = x * _P2
    x = x ^ (x >> U64(33))
    x = x * _P3
    return x ^ (x >> U64(33))


def shingle_hashes(words: list[bytes], k: int, seen: WordHash) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles; fewer words than k make one shingle; no words make none."""
    n = len(words)
    if n == 0:
        return np.empty(0, U64)
    ids = np.fromiter(map(seen.__getitem__, words), U64, n)
    width = min(k, n)
    h = np.full(n - width + 1, width, U64)
    for i in range(width):
        h = h * _P1 + ids[i : n - width + 1 + i]
    return np.unique(mix(h))


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def slices(batch: pa.RecordBatch, rows: int, text: int | None = None, size: int = 4_000_000):
    """Pieces of at most `rows` rows and, by the column numbered `text`, of little more than `size` bytes (one row at least), so that
    what a worker holds stays small."""
    if text is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        n = min(rows, max(1, int(np.searchsorted(upto, before + size, "right")) - at))
        yield batch.slice(at, n)
        at += n


def set_aside(df: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Rename the columns of `df` that an operator's results would replace; `put_back` undoes it."""
    lower = {m.lower() for m in made}
    names = {c: fresh(f"{c}_before", [*df.columns, *made]) for c in df.columns if c.lower() in lower}
    return df.withColumnsRenamed(names), names


def put_back(df: DataFrame, made: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """Drop the results and give the renamed columns their names again."""
    return df.drop(*made).withColumnsRenamed({v: k for k, v in names.items()})


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name` with as many underscores in front as it takes to clash with none of the `taken` names."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name = f"_{name}"
    return name


def release() -> None:
    """Give freed memory back to the system at a task's end; workers stay, and an executor's memory holds several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
