import math

from veridra.llm.topk import TopKConfig, top_k


def brute(rows, k=5):
    """Every pair of finite vectors of one length whose score a long holds."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q, x in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(x) == len(y))
            fit = [(s, i) for s, i in scored if -(2**63) <= -s < 2**63]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(fit[:k])]
    return sorted(out)


def test_every_finite_vector_takes_part(spark):
    rows = [(i, [float((i * 37 + j * 11) % 23 - 9) for j in range(3)]) for i in range(120)]
    rows += [(200, [70_000.0, -65_536.0, 1.0]), (201, [65_536.0, 0.5, -2.0]), (202, [1e6, 1e6, -1e6]), (203, [1e12, 3.0, 1.0]), (250, [3e8, -2e8, 5.0])]
    rows += [(300, [1.0, 1.0, 2.0]), (301, [1e30, -1e30, 3e9]), (302, [1e30, 1.0, 1.0]), (350, [-1e30, 1e30, 0.5]), (400, []), (401, []), (402, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    seen = {v for _, _, v, _ in want}
    assert {200, 201, 202, 203, 250, 301, 401, 402} <= seen and {200, 250, 350, 400} <= {q for q, *_ in want}
    for cfg in (TopKConfig(), TopKConfig(block=20, queries=3)):
        assert sorted(tuple(r) for r in top_k(df, cfg=cfg).collect()) == want
