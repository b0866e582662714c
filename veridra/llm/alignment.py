"""Alignment of two tokenizers' tokens over a corpus: tokens that cover the same bytes, and how many documents link each pair of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from veridra.llm.bpe import Codec, byte_characters
from veridra.llm.common import list_column, release, slices, written

#: bytes of text that are aligned at a time; they make one block
SIZE = 2_000_000
#: an irregular group with more links than this has them counted from its distinct ids
WIDE = 256
_ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_times array<int>, pairs array<long>, pair_times array<int>"


class Strings:
    """Byte strings by number, joined without a Python object for each."""

    def __init__(self, items: list[bytes]):
        self.length = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def join(self, numbers: np.ndarray, at_once: int = 500_000) -> bytes:
        """The strings of the given numbers, end to end; some at a time, so that a long text needs little more than its result."""
        out = []
        for at in range(0, len(numbers), at_once):
            some = numbers[at : at + at_once]
            length = self.length[some]
            ends = np.cumsum(length)
            out.append(self.data[np.arange(int(ends[-1])) + np.repeat(self.start[some] - ends + length, length)].tobytes())
        return b"".join(out)


class ByteLevel(Codec):
    """A byte-level BPE from a tokenizer file: pieces by `pattern`, remembered like those of `Codec`; special tokens are plain text."""

    limit = 150_000  # about twice the distinct pieces of one block

    def __init__(self, path: str, pattern: str):
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(pattern)
        back = {c: b for b, c in byte_characters().items()}
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.forget()


class Pieces:
    """A sentencepiece model; it puts a space before every text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.model.id_to_piece, range(n)))
        ]
        # the piece that the encoder prefers for bytes that two ids stand for
        self.id_of = {b: i for i, b in reversed(list(enumerate(self.bytes_of))) if b and self.model.is_byte(i)}
        self.id_of |= {b: i for i, b in reversed(list(enumerate(self.bytes_of))) if b and not self.model.is_byte(i)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class Aligner:
    """Both vocabularies, and for every A id the B id of the same bytes (-1 where there is none)."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = ByteLevel(a_path, pattern), Pieces(b_path)
        self.bytes_a, self.bytes_b = Strings(self.a.bytes_of), Strings(self.b.bytes_of)
        self.len_a, self.len_b = self.bytes_a.length, self.bytes_b.length
        self.same = np.array([self.b.id_of.get(x, -1) if x else -1 for x in self.a.bytes_of], np.int64)
        # decimal ids with what may follow them: another id, the other side, the next group
        self.shown = Strings([f"{i}{s}".encode() for s in (",", "|") for i in range(len(self.len_a))] + [f"{i}{s}".encode() for s in (",", ";") for i in range(len(self.len_b))])

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides per text; none where a side does not give back the text's bytes."""
        spaced = [" " + t if t else "" for t in texts]
        a, b = self.a.encode(spaced), self.b.encode([t or "" for t in texts])
        want = [x.encode("utf-8", "surrogatepass") for x in spaced]
        whole = np.array([bool(x) for x in want])
        for ids, strings in ((a, self.bytes_a), (b, self.bytes_b)):
            size = [int(strings.length[x].sum()) for x in ids]
            back, at = strings.join(np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64)), 0
            for i, n in enumerate(size):
                whole[i] &= back[at : at + n] == want[i]
                at += n
        for i in np.flatnonzero(~whole):
            a[i] = b[i] = np.empty(0, np.int64)
        return a, b

    def align(self, a: list[np.ndarray], b: list[np.ndarray]) -> dict:
        """Groups and links of several texts at a time. Texts lie end to end, so that one pass over byte offsets cuts all of them."""
        n = len(a)
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        ids_a, ids_b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        groups = int(cut_a.sum())
        group_a, group_b = (np.cumsum(c) - c for c in (cut_a, cut_b))
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        doc_of = np.repeat(np.arange(n), n_a)[from_a] if groups else np.empty(0, np.int64)
        links = in_a * in_b
        plain = (in_a == 1) & (in_b == 1)
        first_a, first_b = ids_a[from_a], ids_b[from_b]
        exact = plain & (self.same[first_a] == first_b)
        odd = np.flatnonzero(~exact)
        doc, x, y, times = self._links(ids_a, ids_b, from_a[odd], in_a[odd], from_b[odd], in_b[odd], doc_of[odd])
        # identical bytes inside irregular groups are links of the identity map too: a document counts once for them
        mapped = self.same[x] == y
        same = self._per_doc(n, [doc_of[exact], doc[mapped]], [first_a[exact], x[mapped]], [np.ones(int(exact.sum()), np.int64), times[mapped]])
        pairs = self._per_doc(n, [doc[~mapped]], [x[~mapped] * len(self.len_b) + y[~mapped]], [times[~mapped]])
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc_of, minlength=n),
            "n_links": np.bincount(doc_of, weights=links, minlength=n).astype(np.int64),
            "groups": self._shown(ids_a, ids_b, group_a, group_b, cut_a, cut_b, from_a + in_a, from_b, n_a, n_b),
            "same": same,
            "pairs": pairs,
        }

    def _links(self, ids_a, ids_b, from_a, in_a, from_b, in_b, docs) -> tuple[np.ndarray, ...]:
        """(document, A id, B id, times) of the links inside the given groups. Wide groups give each distinct pair of ids once, so that
        a text whose tokens rarely end together costs no more than its ids."""
        wide = in_a * in_b > WIDE
        out = []
        for g in np.flatnonzero(wide).tolist():
            x, cx = np.unique(ids_a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            y, cy = np.unique(ids_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            out.append((np.full(len(x) * len(y), docs[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(cx, cy).ravel()))
        s = ~wide
        size = (in_a * in_b)[s]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(in_b[s], size)
        x = ids_a[np.repeat(from_a[s], size) + at // np.maximum(width, 1)]
        y = ids_b[np.repeat(from_b[s], size) + at % np.maximum(width, 1)]
        out.append((np.repeat(docs[s], size), x, y, np.ones(len(x), np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out))

    @staticmethod
    def _per_doc(n: int, docs, keys, times) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each document's distinct keys in order, and how often it has each."""
        doc, key, times = (np.concatenate(x).astype(np.int64) for x in (docs, keys, times))
        order = np.argsort(doc << 40 | key)  # keys, pairs of ids, and documents of a block are far below 2 ** 40 and 2 ** 23
        doc, key, times = doc[order], key[order], times[order]
        new = np.ones(len(key), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(times, at) if len(at) else times
        upto = np.cumsum(np.bincount(doc[at], minlength=n))[:-1]
        return np.split(key[at], upto), np.split(total, upto)

    def _shown(self, ids_a, ids_b, group_a, group_b, cut_a, cut_b, upto_a, from_b, n_a, n_b) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` per document: both sides' tokens in the order of their groups, A before B."""
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        va, vb = len(self.len_a), len(self.len_b)
        codes[np.arange(len(ids_a)) + from_b[group_a]] = ids_a + va * cut_a
        codes[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * va + ids_b + vb * cut_b
        text, ends = self.shown.join(codes), np.concatenate([[0], np.cumsum(self.shown.length[codes])])
        upto = ends[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [text[at : end - 1] if end > at else b"" for at, end in zip(upto, upto[1:])]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    return Aligner(a_path, b_path, pattern)


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its counts, the digest of its groups, its distinct identity links (`same`, by A id, with `same_times`) and its
    other links (`pairs`, A id x size of B + B id, with `pair_times`). `block` numbers the texts that were aligned together. Texts that
    are null, empty or not given back by both sides have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, pattern)
        block = TaskContext.get().partitionId() << 32
        try:
            for batch in batches:
                for piece in slices(batch, 5000, 1, SIZE):
                    a, b = al.encode(piece.column(1).to_pylist())
                    got = al.align(a, b)
                    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(a), block)),
                            piece.column(0),
                            *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                            pa.array(digests, pa.string()),
                            *(list_column(got["same"][i], pa.int32()) for i in (0, 1)),
                            *(list_column(got["pairs"][i], t) for i, t in ((0, pa.int64()), (1, pa.int32()))),
                        ],
                        names=[f.split()[0] for f in _ALIGNED.split(", ")],
                    )
                    block += 1
        finally:
            al.a.forget()
            release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, _ALIGNED)


def _flat(column: pa.Array) -> np.ndarray:
    """All values of a list column, in order."""
    return column.flatten().to_numpy(zero_copy_only=False)


def identity_counts(rows: DataFrame, size: int) -> DataFrame:
    """(a, n): how many documents hold the identity link of A id `a`. A task adds up one vector as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["a", "n"])

    return rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(block, pair, n): how many documents of a block hold an irregular pair. A block's documents lie together, so each block that a
    batch holds is counted where it lies; a block that spans batches gives several rows for a pair, which later sums add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, lists = batch.column(0).to_numpy(), batch.column(1)
            for block in np.unique(blocks).tolist():
                pair, n = np.unique(_flat(lists.filter(pa.array(blocks == block))), return_counts=True)
                for at in range(0, len(pair), 50_000):
                    p, c = pair[at : at + 50_000], n[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.array(p), pa.array(c, pa.int64())], names=["block", "pair", "n"])

    return rows.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align A's and B's tokens in every whole text: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_exact), a row
    per row.

    Byte offsets where both sides' tokens end cut a text into groups; all A-B pairs inside a group are linked. A pair's count is the number
    of documents that hold it, over the whole corpus. `n_best` counts links whose count is the highest of their A id, `count_sum` adds up
    counts over links, `n_exact` counts links between tokens of the same bytes.

    Links between tokens of the same bytes, most of all, are counted in vectors as long as A's vocabulary and never shuffled. Only other
    pairs meet in a shuffle, once per block of documents however many of them hold the pair; their counts go back to the
    blocks the same way, so that no frequent pair or document is a hot key. What reaches the driver are two vectors of A's length.

    Null and empty texts, and texts that a side does not give back (U+2581 in them), have zeros and an empty digest. Repeated rows and ids
    count as documents of their own. An empty table gives no rows; other columns are not looked at. A text's memory is some 100 bytes per
    byte at most, one very long text at a time.
    """
    spark = docs.sparkSession
    al = aligner(a_path, b_path, pattern)
    n_a, n_b = len(al.len_a), len(al.len_b)
    rows = written(aligned(docs, a_path, b_path, pattern, id_col, text_col), "aligned")
    blocks = written(block_pairs(rows), "pairs")
    counts = written(blocks.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    # a row per A id at most
    identity, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    for r in identity_counts(rows, n_a).collect():
        identity[r.a] = r.n
    for r in counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("count").alias("n")).collect():
        best[r.a] = r.n
    best = np.maximum(best, identity)
    top = spark.sparkContext.broadcast((identity, best))
    kept = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f for f in _ALIGNED.split(", ") if f.split()[0] in kept)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, best = top.value
        for batch in batches:
            same, times = batch.column(len(kept)), _flat(batch.column(len(kept) + 1))
            ids, of = _flat(same), np.repeat(np.arange(batch.num_rows), same.value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.bincount(of, weights=w, minlength=batch.num_rows).astype(np.int64) for w in (times * (identity[ids] == best[ids]), times * identity[ids], times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *batch.columns[len(kept) + 2 :], *map(pa.array, sums)], schema.names)

    # the links of the identity map need only the two vectors; what is left needs the counts of the block's pairs
    rest = rows.select(*kept, "same", "same_times", "pairs", "pair_times")
    schema = spark.createDataFrame([], f"{kinds}, pairs array<long>, pair_times array<int>, best long, total long, n_exact long").schema
    rest = rest.mapInArrow(exact, schema)
    # one row per block and pair; each side is shuffled by a key that no third of the rows shares
    looked_up = blocks.groupBy("block", "pair").agg(F.lit(1).alias("_")).join(counts.hint("merge"), "pair").select("block", "pair", "count")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_exact long"

    def add(docs: pa.Table, found: pa.Table) -> pa.Table:
        lists, times = docs["pairs"].combine_chunks(), _flat(docs["pair_times"].combine_chunks())
        pair, count = found["pair"].to_numpy(), found["count"].to_numpy()
        order = np.argsort(pair)
        pair, count, ids = pair[order], count[order], _flat(lists)
        n = count[np.searchsorted(pair, ids)]  # every pair of a block's documents is among the block's
        of = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        best = top.value[1]
        sums = [np.bincount(of, weights=w, minlength=docs.num_rows).astype(np.int64) for w in (times * (n == best[ids // n_b]), times * n)]
        return pa.table(
            {
                **{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                "n_best": pa.array(sums[0] + docs["best"].to_numpy()),
                "count_sum": pa.array(sums[1] + docs["total"].to_numpy()),
                "groups_sha256": docs["groups_sha256"],
                "n_exact": docs["n_exact"],
            }
        )

    return rest.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(add, out)
