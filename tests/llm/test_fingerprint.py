import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veridra.llm.common import WordHash
from veridra.llm.fingerprint import SketchConfig, containment, fingerprints, from_text, likeness, merge, sketch_text, to_text


M64 = 2**64 - 1


def finish(x):
    for prime in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * prime) & M64
    return x ^ x >> 33


def hashes(text):
    """The upper halves of all five-word shingles' hashes, in plain integers."""
    words = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    width = min(5, len(words))
    out = set()
    for i in range(len(words) - width + 1 if words else 0):
        h = width
        for w in words[i : i + width]:
            h = (h * 0x9E3779B97F4A7C15 + w) & M64
        out.add(finish(h) >> 32)
    return out


def plain_sketch(found):
    return {h for h in found if h < 2**29} or set(sorted(found)[:1])


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Rows in order of id, each with its successor, without the operator's code."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        m = len(t) // 4
        e = t[: len(t) - m] + n[:m]
        a, b, c = (plain_sketch(hashes(x)) for x in (t, e, n))
        shown = lambda s: "".join(f"{h:08x}" for h in sorted(s))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c), len(a & c) / len(c) if c else 1.0))
    return out


def test_whole_table_equals_brute_force(spark):
    from veridra.llm.queries import op2_fingerprints

    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op2_fingerprints(spark, d).collect())
    assert got == brute(rows)
    # the edited text keeps three quarters of the words
    near = np.mean([r[5] for r in got])
    assert 0.5 < near < 0.75 and np.mean([r[6] for r in got]) < 0.1


def test_estimates_follow_true_likeness():
    rng, seen, cfg = np.random.default_rng(1), WordHash(), SketchConfig()
    words = [f"w{i}" for i in rng.integers(0, 10**6, 6000)]
    whole, half, tenth = (sketch_text(" ".join(words[:n]), cfg, seen) for n in (6000, 3000, 600))
    assert abs(likeness(whole, half) - 0.5) < 0.08 and abs(containment(tenth, whole) - 1) < 1e-9
    assert abs(containment(whole, tenth) - 0.1) < 0.05
    rest = sketch_text(" ".join(words[2996:]), cfg, seen)
    assert np.array_equal(merge(cfg, half, rest), whole) and np.array_equal(from_text(to_text(whole)), whole)


def test_merge_equals_the_sketch_of_both_texts():
    rng, seen, cfg = np.random.default_rng(4), WordHash(), SketchConfig()
    for sizes in [(6, 60), (3, 6), (6, 6), (1, 200), (0, 6), (0, 0)] * 40:
        texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, n)) for n in sizes]
        want = plain_sketch(set().union(*map(hashes, texts)))
        assert set(merge(cfg, *(sketch_text(t, cfg, seen) for t in texts)).tolist()) == want


def test_ranges_of_every_number(spark):
    rows = [(i * 7 % 101 - 50, f"text {i} of a few words more") for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 40, 10**6):
        assert sorted(tuple(r) for r in fingerprints(df, cfg=SketchConfig(range_bytes=size)).collect()) == brute(rows)


def test_edges_of_the_input(spark):
    rows = [(3, None), (1, "a b c d e f"), (2, ""), (2**40, "x " * 40_000), (7, "é" * 9), (8, "same words here now ok"), (9, "same words here now ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slot", "2 as guest", "3 as id")
    got = sorted(tuple(r) for r in fingerprints(df).collect())
    assert got == brute(rows) and got[5][3] == got[4][3]
    assert fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.filter("doc_id = 1")).first()
    assert one.near_next == 1.0
    twice = df.union(df.filter("doc_id = 1")).union(df.selectExpr("null", "text", "slot", "guest", "id").limit(2))
    assert fingerprints(twice).count() == len(rows) + 3


def test_rows_of_one_id_are_dealt_over_ranges(spark):
    df = spark.range(400).selectExpr("5L as doc_id", "concat('row ', id, ' of the same id') as text")
    got = fingerprints(df, cfg=SketchConfig(range_bytes=1000)).collect()
    texts = [r.text for r in df.orderBy(F.xxhash64("text")).collect()]
    want = brute([(i, t) for i, t in enumerate(texts)])
    assert sorted(tuple(r)[1:] for r in got) == sorted(r[1:] for r in want)
