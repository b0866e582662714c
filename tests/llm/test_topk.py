import numpy as np

from veridra.llm.topk import TopKConfig, nra_block, top_k


def brute(rows, k=5):
    import math

    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(ok):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(ok) if m != n and len(x) == len(y))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_whole_table_equals_brute_force(spark):
    from veridra.llm.queries import op3_top_k

    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op3_top_k(spark, d).collect()) == brute(rows)


def test_early_stop_and_many_blocks_give_equal_results(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.2, 6)).tolist()) for i in range(900)] + [(1000 + i, [1.0] * 6) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    for cfg in (TopKConfig(), TopKConfig(block=100, queries=7), TopKConfig(depths=(0.05, 0.2, 0.6, 0.9))):
        assert sorted(tuple(r) for r in top_k(df, cfg=cfg).collect()) == want


def test_bounds_hold_in_every_number_range():
    rng = np.random.default_rng(3)
    for scale in (3, 5_000, 2**23):
        block = rng.integers(-scale, scale, (400, 5))
        ids = np.arange(400) * 3
        got = nra_block(ids, block, ids[:9], block[:9], TopKConfig(depths=(0.1, 0.3, 0.8)))
        for q in range(9):
            s = block @ block[q]
            want = sorted((-int(s[i]), int(ids[i])) for i in range(400) if i != q)[:5]
            assert [(-score, v) for p, v, score in got if p == ids[q]] == want


def test_edges_of_the_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, [nan, 1.0]), (150, None), (1, [1.0, inf]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, []), (None, [1.0, 1.0]), (5, [1.0]), (200, [2.0]), (6, [1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as x", "3 as qb")
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert got == brute([r for r in rows if r[1] is None or 1e30 not in r[1]])
    assert top_k(df.limit(0)).count() == 0


def test_every_row_counts_where_ids_repeat(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.5, 0.0]), (7, [0.9, 0.0]), (9, [0.6, 0.0])]
    kind = "vec_id long, embedding array<double>"
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, kind)).collect())
    assert got == brute(rows) and got[0] == (0, 1, 7, 58880)
    rng = np.random.default_rng(5)
    rows = [(int(i) * 10, [float(x) for x in v]) for i, v in zip(rng.integers(0, 12, 300), rng.integers(-2, 3, (300, 2)) / 4)] + [(100, [1.0, 1.0])] * 9 + [(100, [1.0, -1.0])] * 2 + [(101, [1.0, 1.0])] * 3
    df = spark.createDataFrame(rows, kind).repartition(3)
    for cfg in (TopKConfig(), TopKConfig(block=20, queries=6), TopKConfig(block=50, depths=(0.2, 0.5, 0.9))):
        assert sorted(tuple(r) for r in top_k(df, cfg=cfg).collect()) == brute(rows)
