import zlib

import numpy as np
import pytest

from veridra.llm.langid import BiGRU, LangIdConfig, columns, identify, sample, train


def test_gradients_equal_differences():
    net = BiGRU(3, 2, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = columns([np.array([5, 9, 200]), np.array([9, 1]), np.array([3, 3, 3, 7])], 4)
    y = np.array([0, 1, 1])

    def loss():
        logits = net.p["Wf"] @ net.states(x, "f", []) + net.p["Wb"] @ net.states(x, "b", []) + net.p["c"]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        picked = p[:, y, np.arange(3)]
        return -(np.log(picked) * (x != 256)).sum() / (x != 256).sum()

    grads = net.gradients(x, y)
    for k in ("Uf", "Ub", "Wf", "c", "Ef", "Eb"):
        flat, at = net.p[k].reshape(-1), (9 if k[0] == "E" else 0)
        for i in range(at, min(at + 4, flat.size)):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - grads[k].reshape(-1)[i]) < 2e-3, k


def test_held_out_accuracy(spark):
    from veridra.llm.queries import op8_language_id

    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op8_language_id(spark, d).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def plain_read(net, langs, text):
    """(language, mean probability), one byte after the other, in stretches as even as they can be cut."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.encode()
    n = -(-len(data) // 128)
    sizes = [len(data) // n + (i < len(data) % n) for i in range(n)]
    squash = lambda v: 1 / (1 + np.exp(-v.astype(float)))
    total, h, at = np.zeros(len(langs)), net.h, 0
    for size in sizes:
        part, logits = data[at : at + size], np.repeat(net.p["c"].T.astype(float), size, axis=0)
        at += size
        for d, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                e, a = net.p["E" + d][:, part[t]], net.p["U" + d] @ s
                z, r = squash(e[:h] + a[:h]), squash(e[h : 2 * h] + a[h : 2 * h])
                m = np.tanh(e[2 * h :] + r * a[2 * h :])
                s = z * s + (1 - z) * m
                logits[t] += net.p["W" + d] @ s
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        total += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
    return langs[total.argmax()], total.max() / total.sum()


def test_whole_texts_equal_a_plain_forward_pass(spark):
    from veridra.llm.queries import op8_language_id

    d, cfg = "/root/testdata/sf0.001", LangIdConfig()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts, labels, langs = sample(docs, "text", "lang", "doc_id", cfg)
    net = train(texts, labels, len(langs), cfg)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in op8_language_id(spark, d).collect():
        lang, score = plain_read(net, langs, text[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_numbers_that_look_like_letters_are_none(spark):
    rows = [(1, "the cat", "en"), (2, "der hund", "de"), (3, "½ ² 123", None), (4, "١٢٣ Ⅷ", None), (5, "漢", None), (6, "_", None)]
    out = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), cfg=LangIdConfig(steps=5)).collect()}
    assert out[3] == out[4] == out[6] == "und" != out[5]


def test_every_language_is_learned_or_it_is_an_error(spark):
    rows = [(i, "abc def", f"l{i % 70}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(sample(df, "text", "lang", "doc_id", LangIdConfig())[2]) == 70
    with pytest.raises(ValueError, match="more than 69 languages"):
        sample(df, "text", "lang", "doc_id", LangIdConfig(max_langs=69))


def test_edges_of_the_input(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "en"), (6, "the the " * 30_000, None), (6, "und", "de"), (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as held_out", "3 as l")
    quick = LangIdConfig(steps=20)
    got = identify(df, cfg=quick).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, i): r for i, r in enumerate(got)}
    assert all(r.lang_pred == "und" and r.score == 0 for (d, _), r in by.items() if d in (3, 4, 5))
    assert all(r.lang_pred in ("en", "de") for (d, _), r in by.items() if d in (1, 2, 6))
    assert identify(df.limit(0), cfg=quick).count() == 0
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(0, 0).try_cast("int").cast("string")), cfg=quick).collect()} == {"und"}
