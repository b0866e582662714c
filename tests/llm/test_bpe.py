import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from veridra.llm.bpe import Codec, bpe_decode, bpe_digest, bpe_encode, decode_text

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken_for_every_character(codec, reference):
    texts = ["a" + c + c + " " + c + "1" + c for c in map(chr, [*range(0x3000), *range(0x3000, 0x110000, 23)]) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(texts), 5000):
        part = ["\n".join(texts[i : i + 50]) for i in range(at, min(at + 5000, len(texts)), 50)]
        assert [x.tolist() for x in codec.encode(part)] == reference.encode_ordinary_batch(part)


def test_ids_equal_tiktoken_for_random_token_strings(codec, reference):
    random.seed(3)
    tokens = [t.decode("utf-8", "ignore") for t in random.sample([b for b in codec.bytes_of if b], 5000)]
    texts = ["".join(random.choices(tokens, k=40)) for _ in range(500)] + ["", " ", "  \n \t x", "don't  'll'S", "<|endoftext|>"]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == reference.encode_ordinary_batch(texts)
    assert [codec.decode(i).decode() for i in ids] == texts


def test_control_characters_and_odd_blanks_equal_tiktoken(codec, reference):
    odd = [chr(c) for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    texts = [f"a{x}{y}b {x}1{y}{y} c" for x in odd for y in odd]
    assert [x.tolist() for x in codec.encode(texts)] == reference.encode_ordinary_batch(texts)


def test_piece_memory_is_bounded(codec, reference):
    small = Codec(RANKS, P.PATTERN)
    small.limit = 3
    texts = ["one two three four five six", "six seven eight nine ten one two"]
    for _ in range(2):
        assert [x.tolist() for x in small.encode(texts)] == reference.encode_ordinary_batch(texts)


def test_offsets_and_split_characters(codec):
    text = "é漢字 𝄞x"
    ids = codec.encode([text])[0]
    spots = codec.offsets(ids, text.encode())
    lead = 0
    for i, at in zip(ids.tolist(), spots.tolist()):
        assert at == len(text.encode()[: lead + 1].decode("utf-8", "ignore")) or text.encode()[:lead].decode("utf-8", "ignore") == text[:at]
        lead += len(codec.bytes_of[i])
    raw = text.encode()
    for cut in range(len(raw) + 1):
        assert "".join(decode_text([raw[:cut], raw[cut:]])) == text


def test_round_trip_nulls_and_clashing_columns(spark):
    rows = [(1, "héllo  wörld"), (2, None), (3, ""), (3, ""), (4, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded", "'mine' as _t", "'too' as _TEXT")
    back = bpe_decode(bpe_encode(df, RANKS, P.PATTERN, offsets=True), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t in rows]
    assert all(len(r.ids) == len(r.offsets) and (r._t, r._TEXT) == ("mine", "too") for r in back)
    once = bpe_encode(df, RANKS, P.PATTERN, offsets=True, decoded=True).select(*back[0].__fields__).orderBy("doc_id").collect()
    assert once == back
    assert bpe_digest(df.limit(0), RANKS, P.PATTERN).count() == 0
    none = bpe_digest(df.filter("doc_id = 2"), RANKS, P.PATTERN).first()
    assert none.n_tokens == 0 and none.n_bytes == 0 and none.ids_sha256 == none.decoded_sha256


def test_whole_table_equals_tiktoken(spark, reference):
    from veridra.llm.queries import op9_byte_bpe

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = op9_byte_bpe(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_ids():
    assert Codec(RANKS, P.PATTERN).decode(np.empty(0, np.int64)) == b""
