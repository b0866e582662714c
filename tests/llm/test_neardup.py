import random

from veridra.llm.neardup import NearDupConfig, components, near_duplicates


def sets(rows, k=3):
    out = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    return out


def brute(rows, k=3, percent=85):
    """Every pair compared, components by repeated minima."""
    docs = sets(rows, k)
    best = {d: d for d, _ in docs}
    links = [(a, b) for i, (a, x) in enumerate(docs) for b, y in docs[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                moved = True
    return sorted((d, len(s), best[d], best[d] == d) for d, s in docs)


def got(df, **kw):
    return sorted(tuple(r) for r in near_duplicates(df, **kw).collect())


def test_whole_table_equals_brute_force(spark):
    from veridra.llm.queries import op10_near_duplicates

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op10_near_duplicates(spark, d).collect()) == brute(rows)


def test_drifting_group_equals_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for d in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert got(df, cfg=NearDupConfig(k=5, percent=80, bands=40)) == brute(rows, 5, 80)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One two"), (5, "one\ttwo "), (6, "one"), (7, "a b c"), (7, "a b c"), (None, "a b c"), (8, "A B C"), (9, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as key", "3 as n")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert (1, 0, 1, True) in out and (2, 0, 2, True) in out and (3, 0, 3, True) in out
    assert (5, 1, 4, False) in out and (6, 1, 6, True) in out
    assert (8, 1, 7, False) in out and (None, 1, None, False) in out and (9, 1, 9, True) in out
    assert near_duplicates(df).count() == len(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "u long, v long")
    roots = dict(components(edges).collect())
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}
