import base64
import re
from collections import Counter

import corpus_pipeline as P
import test_mixing
import tiktoken
from test_neardup import brute
from test_pii import plain_text

from veridra.llm.pii import PiiConfig


def test_stages_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], d), "test"))
        if name != P.STAGES[-1][0]:
            assert out[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in x.collect()} for x in out[:5]]
    assert set(texts[1]) == {i for i, t in texts[0].items() if re.search(r"[^\W\d_]", t)}
    kept = {i for i, _, _, k in brute(sorted(texts[1].items()), 5, 80) if k}
    assert set(texts[2]) == kept and all(texts[2][i] == texts[1][i] for i in kept)
    assert set(texts[3]) == kept and set(texts[4]) <= kept
    rows = out[5].collect()
    assert len(rows) == out[4].count() and all(r.whole and r.n_tokens == len(r.ids) for r in rows)


def test_whole_rows_of_every_stage_equal_plain_python(spark):
    """Each stage's rows, all columns, from the rows of the one before; language from the network's own verdicts, which test_langid holds against a
    forward pass byte by byte."""
    d = "/root/testdata/sf0.001"
    out = [spark.read.parquet(f"{d}/documents.parquet")]
    for _, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], d), "test"))
    rows = [x.collect() for x in out]
    verdict = {r.doc_id: r for r in P.with_language(out[0]).collect()}
    good = {i for i, v in verdict.items() if v.lang_pred != "und" and v.score >= P.LEAST_SCORE}
    by_id = lambda r: r.doc_id
    assert sorted(map(tuple, rows[1])) == sorted((r.doc_id, r.text, r.lang or verdict[r.doc_id].lang_pred, r.source, r.n_chars) for r in rows[0] if r.doc_id in good)
    first = {i for i, _, _, keep in brute(sorted((r.doc_id, r.text) for r in rows[1]), 5, 80) if keep}
    assert sorted(rows[2], key=by_id) == sorted((r for r in rows[1] if r.doc_id in first), key=by_id)
    changed = [(r.doc_id, plain_text(r.text, PiiConfig().key)[0], r.lang, r.source) for r in rows[2]]
    assert sorted(map(tuple, rows[3])) == sorted((i, t, lang, source, len(t)) for i, t, lang, source in changed)
    times = test_mixing.brute([(r.doc_id, r.lang, r.source, len(re.findall(r"\S+", r.text))) for r in rows[3]], P.MIX)
    assert Counter(map(tuple, rows[4])) == Counter({tuple(r): times[r.doc_id] for r in rows[3] if times[r.doc_id]})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codes = {r.doc_id: coder.encode_ordinary(r.text) for r in rows[3]}
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.whole) for r in rows[5]) == Counter((r.doc_id, r.lang, r.source, len(codes[r.doc_id]), tuple(codes[r.doc_id]), True) for r in rows[4])


def test_edges_of_the_input(spark):
    rows = [(1, None, "en", "src1", 0), (2, "", None, None, 0), (3, "the cat sat on the mat today", "en", "src1", 28), (3, "the cat sat on the mat today", "en", "src1", 28), (4, "der hund und die katze im haus", None, "src2", 30), (5, "the cat " * 20_000, "en", "src1", 160_000), (None, "das haus und der hund", "de", None, 21)]
    rows += [(i, f"{'the old man and the sea' if i % 2 else 'der alte mann und das meer'} number {i} {i * i}", "en" if i % 2 else "de", "src2", 30) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as copies", "2 as score", "3 as node")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in P.STAGES:
            now = P.written(stage(spark, now, ""), "test")
        assert now.isEmpty() == empty
