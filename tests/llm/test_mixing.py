import hashlib
import re
from collections import defaultdict

from veridra.llm.mixing import MixConfig, mix


def fill(budget, children):
    """[(weight, cap)] -> amounts; whoever is full hands the rest on until nothing moves."""
    got, open_ = {}, dict(enumerate(children))
    while open_:
        level = (budget - sum(got.values())) / sum(w for w, _ in open_.values())
        full = {i: c for i, (w, c) in open_.items() if c <= level * w + 1e-9}
        if not full:
            return [got.get(i, level * w) for i, (w, _) in enumerate(children)]
        got |= full
        open_ = {i: x for i, x in open_.items() if i not in full}
    return [got[i] for i in range(len(children))]


def brute(rows, cfg):
    """rows: (id, lang, source, words)."""
    def domain(s):
        m = re.search(r"(\d{1,9})\D*$", s or "")
        return f"d{int(m[1]) % 4}" if m else "d-"

    leaves = defaultdict(list)
    for d, lang, source, n in rows:
        leaves[domain(source), lang or "-", source or "-"].append((d, n))
    amount = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def split(budget, keys, level):
        groups = defaultdict(list)
        for k in keys:
            groups[k[level]].append(k)
        names = sorted(groups)
        weights = [cfg.weights.get((("domain", "lang", "source")[level], x), 1.0) for x in names]
        shares = fill(budget, [(w, cfg.epochs * sum(amount[k] for k in groups[x])) for w, x in zip(weights, names)])
        for x, b in zip(names, shares):
            if level == 2:
                yield groups[x][0], b
            else:
                yield from split(b, groups[x], level + 1)

    copies = {}
    for leaf, budget in split(cfg.share * sum(amount.values()), list(leaves), 0):
        whole = min(cfg.epochs, int(budget / amount[leaf] + 1e-9)) if amount[leaf] else 0
        rest, run = budget - whole * amount[leaf], 0
        place = lambda d: hashlib.md5(f"{cfg.seed}:{whole}:{d}".encode()).hexdigest()
        by = defaultdict(int)
        for d, n in leaves[leaf]:
            by[place(d)] += n
        last = None
        for h in sorted(by):
            if by[h] and run < rest - 1e-9:
                last = h
            run += by[h]
        for d, _ in leaves[leaf]:
            copies[d] = whole + int(whole < cfg.epochs and last is not None and place(d) <= last)
    return copies


def test_whole_table_equals_brute_force(spark):
    from veridra.llm.queries import op6_mixing

    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.lang, r.source, len(r.text.encode().split())) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r.copies for r in op6_mixing(spark, d).collect()}
    assert got == brute(docs, MixConfig(share=0.5))
    cfg = MixConfig({("lang", "es"): 4.0, ("domain", "d1"): 0.5, ("source", "src3"): 2.5}, share=1.2, epochs=3)
    table = spark.read.parquet(f"{d}/documents.parquet")
    assert {r.doc_id: r.copies for r in mix(table, cfg=cfg).collect()} == brute(docs, cfg)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a " * 10, "en", "s1"), (2, "a " * 100, "en", "s5"), (3, "a " * 200, "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.source: r.leaf_budget for r in mix(df, cfg=MixConfig(share=0.5, epochs=1)).collect()}
    # 155 tokens, 77.5 to each domain; s1 has but 10, so its sibling s5 gets 67.5
    assert out == {"s1": 10.0, "s5": 67.5, "s2": 77.5}


def test_edges_of_the_input(spark):
    rows = [(1, None, None, None), (2, "", "en", "x"), (3, "one two", "en", "src1"), (3, "one two", "en", "src1"), (None, "three", "de", "src2"), (5, "w " * 30_000, "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as copies", "2 as domain", "3 as h", "4 as id", "5 as _whole", "6 as _last", "'keep' as _lang", "7 as leaf_domain", "8 as Leaf_Budget", "9 as w", "10 as budget")
    out = mix(df, cfg=MixConfig(share=1.0, epochs=1)).collect()
    assert all((r._whole, r._last, r._lang, r.leaf_domain, r.h, r.w, r.budget) == (5, 6, "keep", 7, 3, 9, 10) for r in out)
    assert len(out) == 6 and all(r.copies == 1 for r in out if r.text and r.text.strip())
    assert mix(df.limit(0)).count() == 0
