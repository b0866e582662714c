import math
import re
from collections import Counter
from itertools import combinations

import pytest

from veridra.llm.url_filter import RULES, UrlFilterConfig, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def listed(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def tokens_of(url):
    words = [w for w in re.split(r"[^\w-]+", url.lower()) if w]
    return sorted({"0" if re.fullmatch(r"[0-9]+", w) else w for w in words})


def miner(pages, labels, cfg):
    """url -> verdict of the best rule, by counting every combination of every labelled url's tokens."""
    bad = {}
    for doc, quality, toxic in labels:
        bad[doc] = bad.get(doc, False) or toxic == 1 or quality == 0
    known = [(tokens_of(url or ""), bad[page]) for page, url in pages if page in bad]
    sets, blocked = Counter(), Counter()
    for tokens, is_bad in known:
        for k in range(1, len(tokens) + 1):
            for some in combinations(tokens, k):
                sets[some] += 1
                blocked[some] += is_bad
    n, n_bad = len(known), sum(b for _, b in known)
    rules = []
    for some, c in sets.items():
        for verdict, both, base in (("block", blocked[some], n_bad), ("allow", c - blocked[some], n - n_bad)):
            if both and both >= max(math.ceil(cfg.support * n), cfg.least) and both / c >= cfg.confidence and both / c / (base / n) >= cfg.lift:
                rules.append((both / c, both / n, " ".join(some), verdict, frozenset(some)))

    def best(url):
        have = set(tokens_of(url)) if url is not None else set()
        return max((r for r in rules if r[4] <= have), key=lambda r: r[:3], default=(None,) * 5)[3]

    return rules, best


@pytest.mark.parametrize("cfg", [UrlFilterConfig(), UrlFilterConfig(support=0.02, lift=1.05), UrlFilterConfig(support=0.02, lift=1.05, small_rules=0, salts=3)])
def test_whole_table_equals_brute_force(spark, cfg):
    from veridra.llm.queries import op5_url_filter

    d = "/root/testdata/sf0.001"
    tables = spark.read.parquet(f"{d}/pages.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    urls = {r.page_id: r.url for r in tables[0].collect()}
    rules, best = miner(urls.items(), [(r.doc_id, r.quality, r.toxic) for r in tables[1].collect()], cfg)
    rows = (op5_url_filter(spark, d) if cfg == UrlFilterConfig() else url_filter(*tables, cfg=cfg)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        rule, verdict = listed(host, path)
        mined = best(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.mined, r.verdict) == (host, path, rule, mined, verdict or mined or "allow")
    assert rules


def test_listed_rules_over_the_larger_table(spark):
    from veridra.llm.queries import op5_url_filter

    d = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op5_url_filter(spark, d).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        rule, verdict = listed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.mined or "allow")


def test_mined_rules_equal_brute_force(spark):
    urls = [(i, f"http://{'bad-bets' if i % 3 == 0 else 'good'}.org/{'win' if i % 6 == 0 else 'news'}/{i}") for i in range(120)]
    labels = [(i, 1, int(i % 3 == 0 and i % 15 != 0)) for i in range(60)]
    pages = spark.createDataFrame([*urls, (500, None), (501, "no scheme"), (502, "x://h?q/en/#"), (0, urls[0][1])], "page_id long, url string").selectExpr("*", "1 as token", "2 as bad")
    marks = spark.createDataFrame([*labels, (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = url_filter(pages, marks, cfg=UrlFilterConfig(support=0.05)).collect()
    assert len(rows) == 124
    # bad-bets blocks with confidence 16/20, good allows always
    for r in rows:
        if r.page_id < 120:
            assert r.verdict == ("block" if r.page_id % 3 == 0 else "allow"), r
    _, best = miner([(r.page_id, r.url) for r in pages.collect()], labels + [(7, None, None)], UrlFilterConfig(support=0.05))
    assert {(r.page_id, r.mined) for r in rows} == {(i, best(u)) for i, u in [*urls, (500, None), (501, "no scheme"), (502, "x://h?q/en/#")]}
    assert {(r.page_id, r.host, r.path, r.verdict) for r in rows if r.page_id >= 500} == {(500, "", "", "allow"), (501, "", "", "allow"), (502, "h", "", "allow")}


def test_no_labels_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in url_filter(pages, none).collect()] == ["allow", "allow"]
    assert url_filter(pages.limit(0), none).count() == 0


def test_few_labelled_urls_of_many_tokens_end(spark):
    import random

    random.seed(1)
    long = [(i, "http://h.org/" + "/".join(f"w{k}" for k in random.sample(range(90), 60))) for i in range(4)]
    same = [(10 + i, f"http://{'spam' if i % 2 else 'fine'}.net/" + "/".join(f"{'s' if i % 2 else 'f'}{k}" for k in range(60))) for i in range(30)]
    pages = spark.createDataFrame(long + same, "page_id long, url string")
    few = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    assert {r.mined for r in url_filter(pages, few).collect()} == {None}
    # sixty tokens that always come together are one item; a url that has one of them fits
    more = pages.union(spark.createDataFrame([(99, "http://other.com/s7"), (98, "http://other.com/f7/x")], "page_id long, url string"))
    marks = spark.createDataFrame([(10 + i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.mined for r in url_filter(more, marks).collect()}
    assert got[99] == "block" and got[98] == "allow" and {got[11], got[13]} == {"block"} and {got[10], got[12]} == {"allow"}


def test_merged_tokens_give_the_rules_of_single_ones(spark):
    import random

    random.seed(3)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    urls = []
    for i in range(150):
        own = random.sample(words, 3)
        own += ["a2", "a1"] if "a" in own else []
        own += ["zc"] if "c" in own else []
        urls.append((i, f"x://h/{'/'.join(own)}"))
    urls += [(200 + i, f"x://h/{u}") for i, u in enumerate(["a1", "a2/zc", "a/b", "zc", "a1/d/zc", "q", ""])]
    labels = [(i, 1, int(random.random() < (0.8 if "a" in u.split("/") else 0.3))) for i, u in urls[:100]]
    cfg = UrlFilterConfig(support=0.03, lift=1.05)
    for config in (cfg, UrlFilterConfig(support=0.03, lift=1.05, small_rules=0, salts=2)):
        rows = url_filter(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), cfg=config).collect()
        rules, best = miner(urls, labels, cfg)
        assert rules and {(r.page_id, r.mined) for r in rows} == {(i, best(u)) for i, u in urls}
