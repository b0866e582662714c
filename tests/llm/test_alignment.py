import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veridra.llm.alignment import Aligner, align_tokenizers
from veridra.llm.queries import op13_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
D = "/root/testdata/sf0.001"
CONTRACT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    """The byte behind each character of byte-level vocabularies, written as its definition."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(texts, models):
    """Groups and links token by token, over whole texts, with both libraries' own encoding."""
    a_model, b_model = models
    back = byte_of()
    every = []
    for text in texts:
        groups = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            bytes_a = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
            bytes_b = []
            for i in b:
                p = b_model.id_to_piece(i)
                bytes_b.append(bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        left.append(a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        right.append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((left, right))
                        left, right = [], []
        every.append(groups)
    docs = Counter()
    for groups in every:
        docs.update({(x, y) for left, right in groups for x in left for y in right})
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    rows = []
    for groups in every:
        links = [(x, y) for left, right in groups for x in left for y in right]
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append(
            (
                sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    return rows


ODD = [
    None, "", " ", "a", "a▁b", "<|endoftext|> and </s> <s> <unk> <0x0A>", "don't  stop\n\n\t  now  ", "naïve café 東京 🙂🙂 ‍ é ﻿",
    "x" * 5000, " " * 3000, "\n" * 700, "ab" * 3000 + "é" * 900, "\x00\x01 \x7f", "1234567890 3.14159", "same text", "same text", "日本語のテキスト" * 300, "=" * 999 + "-" * 1001, "aaa  bbb" * 50,
]


def test_rows_equal_plain_python_for_odd_texts(spark, models):
    docs = spark.createDataFrame([(i % 15, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, block string, pairs int")
    got = sorted(tuple(r) for r in align_tokenizers(docs.repartition(3), A, B, P.PATTERN).select("doc_id", *CONTRACT).collect())
    assert got == sorted((i % 15, *row) for i, row in enumerate(plain(ODD, models)))


def test_the_query_equals_plain_python_over_the_whole_table(spark, models):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in CONTRACT) for r in op13_alignment(spark, D).collect()}
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], models)))
    assert got == want


def test_both_sides_encode_like_their_libraries_for_every_character(models):
    al = Aligner(A, B, P.PATTERN)
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}{c} {c}1{c}" for c in chars[at : at + 50]) for at in range(0, len(chars), 50)]
    want = [x.ids for x in models[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in al.a.encode([" " + t for t in texts])] == want


def test_equal_bytes_are_mapped_and_wide_groups_counted_by_distinct_ids(models):
    al = Aligner(A, B, P.PATTERN)
    for i in (262, 464, 220, 198, 0, 50):
        j = al.same[i]
        assert j < 0 or al.b.bytes_of[j] == al.a.bytes_of[i]
    assert al.same[al.a.bytes_of.index(b" the")] == al.b.id_of[b" the"]


def test_empty_tables_and_null_ids(spark):
    kind = "doc_id long, text string"
    assert align_tokenizers(spark.createDataFrame([], kind), A, B, P.PATTERN).collect() == []
    row = align_tokenizers(spark.createDataFrame([(None, None)], kind), A, B, P.PATTERN).collect()[0]
    assert (row.doc_id, row.n_a, row.n_links, row.count_sum, row.groups_sha256) == (None, 0, 0, 0, "")
