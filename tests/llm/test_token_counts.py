import random

import public_tokenizers as P
import pytest
import regex

from veridra.llm.token_counts import Trie, Unigram, token_counts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return Unigram(RANKS)


def brute(model, word):
    """Best segmentation over all pieces, without any sharing."""
    data = word if isinstance(word, bytes) else word.encode()
    best = [(0.0, 0)]
    for i in range(1, len(data) + 1):
        options = [(best[i - 1][0] + model.worst, -best[i - 1][1] - 1)]
        options += [(best[j][0] + model.score[data[j:i]], -best[j][1] - 1) for j in range(max(0, i - 200), i) if data[j:i] in model.score]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_whole_table_equals_brute_force(spark, model):
    from veridra.llm.queries import op4_token_counts

    d, pieces, known = "/root/testdata/sf0.001", regex.compile(P.PATTERN), {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op4_token_counts(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = pieces.findall(texts[r.doc_id])
        for w in words:
            if w not in known:
                known[w] = brute(model, w)
        assert (r.n_pretokens, r.n_distinct, r.n_tokens) == (len(words), len(set(words)), sum(known[w] for w in words))


def test_shared_and_lone_words_equal_brute_force(model):
    random.seed(5)
    pieces = list(model.score)
    words = [w.encode() for w in ("internationalisation", "international", "inter", "été", "x" * 500, "漢字", "", "a" * 63, "a" * 64, "a" * 65)]
    words += [b"".join(random.choices(pieces, k=random.randint(1, 20))) for _ in range(300)] + [bytes(random.choices(range(256), k=80)) for _ in range(20)]
    want = [brute(model, w) for w in words]
    assert model.counts(words).tolist() == want
    assert [model._alone(w, 7) for w in words if w] == [n for n, w in zip(want, words) if w]
    assert model.counts([]).tolist() == [] and model.counts([b""]).tolist() == [0]


def test_trie_shares_prefixes():
    t = Trie([b"car", b"cart", b"", b"dog", b"car"])
    assert len(t.parent) == 1 + 2 + 2 + 2 + 1 and t.ends[0] == t.ends[4] != t.ends[1] and t.ends[2] == 0
    assert t.parent[t.ends[1]] == t.ends[0]


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "q" * 20_000), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as t")
    out = {r.doc_id: r for r in token_counts(df, RANKS, P.PATTERN).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and out[3].n_pretokens == 2 and out[4].n_pretokens == 1
    assert token_counts(df, RANKS, P.PATTERN).count() == 6 and token_counts(df.limit(0), RANKS, P.PATTERN).count() == 0
