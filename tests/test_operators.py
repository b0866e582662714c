"""Worked examples, refusals and invariants of single operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.functions import text as X
from veridra.operators import checks as K
from veridra.operators import joins as J
from veridra.operators import metrics as M
from veridra.operators import models as R
from veridra.operators import normalize as N
from veridra.operators import select as S
from veridra.operators import splits as P
from veridra.operators.ranks import numbered, quantiles_by
from veridra.sources import files as FS
from veridra.sources.workspace import stored


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_index_codes(spark):
    df = spark.createDataFrame([("A",), ("AA12",), ("B2",), ("7",), (None,)], "code string")
    got = {r.code: (r.index_letter, r.index_number, r.index_rank) for r in N.code_features(df, "code").collect()}
    assert got["A"] == ("A", 0, 1) and got["AA12"] == ("AA", 12, 1) and got["B2"] == ("B", 2, 2) and got["7"] == ("", 7, 0)
    base = {r.code: r.index_rank for r in N.code_features(df, "code", "base26").collect()}
    assert base["A"] == 1 and base["AA12"] == 27
    assert {r.code: r.index_rank for r in N.code_features(df, "code", "nullable").collect()}["7"] is None


def test_missing_indicators(spark):
    df = spark.createDataFrame([(None, None), (2.5, 3), (-1.0, -4)], "points double, solved long")
    assert rows(N.impute_flag(df, {"points": "has_points"}, {"solved": "solved_missing"})) == [(0.0, 0, 0, 1), (0.0, 0, 1, 0), (2.5, 3, 1, 0)]


def test_tag_vocabulary(spark):
    df = spark.createDataFrame([(["red", "blue", "red", "red"],), (["blue", "green"],), ([],), (None,), (["green", "red"],), (["ochre"],)], "tags array<string>")
    assert rows(N.vocabulary(df, "tags", 2)) == [("blue", 2), ("green", 2), ("red", 2)]
    assert rows(N.vocabulary(df, "tags", 3)) == [] and ("ochre", 1) in rows(N.vocabulary(df, "tags", 1))


def test_ages_and_buckets(spark):
    at = spark.createDataFrame([(20 * 86400,)], "t long")
    df = spark.createDataFrame([(10 * 86400, 100), (20 * 86400 - 43200, 5), (None, 7)], "start long, n long")
    got = {r.n: (r.age_days, r.per_day) for r in N.age_normalize(df, "start", "n", at).collect()}
    assert got == {100: (10.0, 10.0), 5: (1.0, 5.0), 7: (1.0, 7.0)}
    for days, label in ((30, "0-1y"), (365, "0-1y"), (366, "1-3y"), (1095, "1-3y"), (1096, "3-5y"), (1825, "3-5y"), (1826, "5y+")):
        assert one(spark, b=N.bucket(F.lit(days), [365, 1095, 1825], ["0-1y", "1-3y", "3-5y", "5y+"])).b == label


def test_collisions_and_absent_columns_are_errors(spark):
    with pytest.raises(ValueError, match="collide"):
        N.snake_case(spark.createDataFrame([(1, 2)], "aB int, a_b int"))
    with pytest.raises(ValueError, match="no column"):
        N.standardize(spark.range(1), {"name": ["title"]})


def test_splits_keep_groups_whole_and_in_order(spark):
    df = spark.createDataFrame([(g, i, 1000 * (g // 2)) for g in range(12) for i in range(2)], "g long, i long, t long")
    for split in (P.group_split(df, "g", (0.5, 0.25, 0.25), 1), P.time_split(df, "t", (0.5, 0.25, 0.25))):
        assert split.count() == 24 and M.group_overlap(split, "g", []).count() == 0 and split.select("split_name").distinct().count() == 3
    forward = P.time_split(df, "t", (0.5, 0.25, 0.25))
    assert all(r.strict_order for r in M.split_ranges(forward, "t").collect())
    assert all(r.violations == 0 for r in P.audit_split(df, forward, ["g", "i"], "t").collect())
    assert rows(P.group_split(df, "g", (0.5, 0.25, 0.25), 1)) == rows(P.group_split(df, "g", (0.5, 0.25, 0.25), 1))
    with pytest.raises(ValueError, match="null"):
        P.time_split(df.union(spark.createDataFrame([(99, 0, None)], df.schema)), "t", (0.5, 0.25, 0.25))


@settings(max_examples=15, deadline=None)
@given(st.integers(3, 400), st.sampled_from([(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.98, 0.01, 0.01), (0.1, 0.1, 0.8)]))
def test_partition_counts_sum_and_are_not_empty(spark, n, ratios):
    counts = list(one(spark, **{f"c{i}": c for i, c in enumerate(P.partition_counts(F.lit(n), ratios))}))
    assert sum(counts) == n and min(counts) >= 1 and all(abs(c - n * r) < 2.01 for c, r in zip(counts, ratios))


def test_rolling_folds(spark):
    times = P.group_times(spark.createDataFrame([(i, i * 10) for i in range(10)], "g long, t long"), "g", "t")
    got = {(r.fold, r.part): r["count"] for r in P.rolling_folds(times, "g", "t", [0.5, 0.6, 0.7, 0.8], 0.1).groupBy("fold", "part").count().collect()}
    assert [got[f, "train"] for f in (1, 2, 3, 4)] == [5, 6, 7, 8] and all(got[f, "test"] == 1 for f in (1, 2, 3, 4))


def test_validation_chooses_and_test_is_only_reported(spark):
    df = spark.createDataFrame([("s", "a", "valid", 100.0), ("s", "b", "valid", 120.0), ("s", "a", "test", 140.0), ("s", "b", "test", 90.0)], "strategy string, model string, split_name string, mae double")
    best = S.select_best(S.validation_ranked(df, ["strategy"], "model", "mae")).first()
    assert (best.model, best.test_mae) == ("a", 140.0)
    with pytest.raises(ValueError, match="duplicate"):
        S.validation_ranked(df.union(df), ["strategy"], "model", "mae")
    with pytest.raises(ValueError, match="finite"):
        S.validation_ranked(df.withColumn("mae", F.when(F.col("mae") == 90, float("nan")).otherwise(F.col("mae"))), ["strategy"], "model", "mae")
    with pytest.raises(ValueError, match="other candidates"):
        S.validation_ranked(df.filter("mae <> 90"), ["strategy"], "model", "mae")


def test_top_errors_break_ties_by_the_listed_columns(spark):
    data = [(t, g, f"i{(t * g) % 5}", float((t + g) % 3)) for t in range(4) for g in range(6)]
    df = spark.createDataFrame(data, "t long, g long, i string, absolute_error double")
    want = sorted(data, key=lambda r: (-r[3], r[2], r[0], r[1]))
    got = S.top_errors(df, 10, [], ["i", "t", "g"]).orderBy("error_rank").collect()
    assert [tuple(r)[:4] for r in got] == want[:10] and [r.error_rank for r in got] == list(range(1, 11))
    per = {t: [r[:4] for r in want if r[0] == t][:2] for t in range(4)}
    assert {(r.t, r.error_rank): tuple(r)[:4] for r in S.top_errors(df, 2, ["t"], ["i", "t", "g"]).collect()} == {(t, k + 1): r for t, rs in per.items() for k, r in enumerate(rs)}


def test_bootstrap_is_paired_and_repeatable(spark):
    data = [("a", g, i, e) for g, i, e in ((1, "A", 10.0), (1, "B", 20.0), (2, "A", 30.0))] + [("b", g, i, e) for g, i, e in ((1, "A", 5.0), (1, "B", 25.0), (2, "A", 15.0))]
    df = spark.createDataFrame(data, "setting string, g long, i string, e double")
    run = lambda x: S.cluster_bootstrap(x, ["g", "i"], "g", "setting", "e", ("a", "b"), 50, 42).first()
    assert run(df).estimate == -5.0 and run(df) == run(df) and run(df).low <= -5.0 <= run(df).high
    with pytest.raises(ValueError, match="paired"):
        run(df.filter("not (setting = 'b' and g = 2)"))


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, [1, 5, 0.1], (200, 3))
    y = x @ [2, -1, 30] + 7 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(v), "train") for r, v in zip(x, y)], "a double, b double, c double, y double, k string")
    g = R.grams(df, ["a", "b", "c"], "y", "k")["train"]
    for alpha in (0.01, 50.0):
        w, b = R.ridge(g, ["a", "c"], alpha)
        z = x[:, [0, 2]]
        s = z.std(axis=0)
        u = (z - z.mean(axis=0)) / s
        want = np.linalg.solve(u.T @ u + alpha * np.eye(2), u.T @ (y - y.mean())) / s
        assert np.allclose(list(w.values()), want) and np.isclose(b, y.mean() - want @ z.mean(axis=0))


def test_trees_repeat_and_beat_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), float((i % 7) ** 2), "train" if i % 4 else "test") for i in range(300)], "id long, a double, b double, y double, split_name string")
    spec = [R.ModelSpec("gb", ("a", "b"), R.gradient_boosting(5, rate=0.3)), R.ModelSpec("rf", ("a", "b"), R.random_forest(5, 4))]
    score = lambda: {r.model_name: r.mae for r in M.regression_metrics(R.evaluate_grid(df, spec, "y", ["id"]).filter("split_name = 'test'"), "actual", "predicted", ["model_name"]).collect()}
    first = score()
    mean = R.mean_model(df, "y").filter("split_name = 'test'").agg(F.avg(F.abs(F.col("predicted") - F.col("y")))).first()[0]
    assert first == score() and max(first.values()) < mean


def test_one_boosted_stump_is_the_best_split(spark):
    data = [(i, float(i % 5), float(i * 7 % 11 % 4), float((i * 13) % 17), "train") for i in range(60)]
    df = spark.createDataFrame(data, "id long, a double, b double, y double, split_name string")
    long = R.evaluate_grid(df, [R.ModelSpec("one", ("a", "b"), R.gradient_boosting(1, rate=1.0, depth=1, l2=0.0, least=1))], "y", ["id"])
    best = None
    for k in (1, 2):
        for cut in sorted({r[k] for r in data})[:-1]:
            sides = [[r[3] for r in data if (r[k] <= cut) == left] for left in (True, False)]
            loss = sum(sum((y - sum(s) / len(s)) ** 2 for y in s) for s in sides)
            if best is None or loss < best[0] - 1e-9:
                best = (loss, {r[0]: sum(s) / len(s) for s, left in zip(sides, (True, False)) for r in data if (r[k] <= cut) == left})
    got = {r.id: r.predicted for r in long.collect()}
    assert all(abs(got[i] - v) < 1e-9 for i, v in best[1].items())


def test_missing_text_is_a_category_and_unknown_text_is_none(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), ("b", 8.0)], "t string, v double")
    rest = spark.createDataFrame([(None, None), ("new", 3.0)], "t string, v double")
    fitted = R.preprocessor(train, ["v", "t"]).fit(train)
    (missing, unknown) = ([float(v) for v in r.x.toArray()] for r in fitted.transform(rest).collect())
    assert sum(missing[1:]) == 1.0 and sum(unknown[1:]) == 0.0
    filled = np.array([1.0, 3.0, 3.0, 8.0])
    assert np.isclose(missing[0], (3 - filled.mean()) / filled.std()) and np.isclose(unknown[0], missing[0])


def test_places_and_quantiles_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    data = [(None if i % 9 == 0 else f"g{min(i % 4, 2)}", None if i % 13 == 0 else float(v)) for i, v in enumerate(np.round(rng.exponential(20, 3000)))] + [("one", 5.0), ("none", None)]
    df = stored(spark.createDataFrame(data, "g string, v double"))
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    for per_range in (20, 10**6):
        got = {r.g: r for r in quantiles_by(df, ["g"], "v", qs, per_range).collect()}
        assert set(got) == {g for g, v in data if v is not None}
        for g, r in got.items():
            values = [v for h, v in data if h == g and v is not None]
            assert r.n == len(values) and np.allclose([r[k] for k in qs], np.quantile(values, list(qs.values())))
    assert quantiles_by(df.limit(0), [], "v", qs).count() == 0
    ranked, n = numbered(spark.range(500).selectExpr("id", "id * 37 % 500 as k"), [F.col("k").desc()], "place")
    assert n == 500 and all(r.place == 500 - r.k for r in ranked.collect())


def test_manifest_digest_does_not_depend_on_order_or_partitions(spark):
    make = lambda ids: spark.createDataFrame([(f"{i}.html", f"{i:064d}", i, "html") for i in ids], "relative_path string, sha256 string, size_bytes long, kind string")
    a, b, c = (M.manifest_summary(make(x), ["html", "pdf"]).first() for x in (range(700), range(699, -1, -1), range(1, 701)))
    assert a == b and a.digest != c.digest and (a.entries, a.html, a.pdf) == (700, 700, 0) and M.manifest_summary(make(range(1)).limit(0), ["html"]).first().entries == 0


def test_joins_refuse_what_they_should(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    twice = spark.createDataFrame([(1, 5), (1, 6)], "k long, w long")
    with pytest.raises(ValueError, match="duplicate"):
        J.left_join(a, twice, ["k"])
    with pytest.raises(ValueError, match="incomplete"):
        J.join_split(a, spark.createDataFrame([(1, "train")], "k long, split_name string"), ["k"])
    with pytest.raises(Exception, match="row without split"):
        J.join_split(a, spark.createDataFrame([(1, "train")], "k long, split_name string"), ["k"], how="left").collect()
    assert J.left_join(a, spark.createDataFrame([(1, "z")], "k long, v string"), ["k"]).columns == ["k", "v", "v_right"]
    with pytest.raises(ValueError, match="fingerprints"):
        K.assert_fingerprint(K.stamp(a, "one"), "two")
    with pytest.raises(ValueError, match="nulls"):
        K.strict_prepare(a.withColumn("t", F.lit(None).cast("long")), {"k": "long", "t": "long"}, ["k"], ["t"], "t")


def test_tables_within_tolerance_are_equal(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "b"), (3, None, "c")], "k long, x double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, ""), (2, 2.1, "b"), (4, 0.0, "d")], "k long, x double, s string")
    assert rows(K.table_diff(a, b, ["k"])) == [(2, "x"), (3, "only in first"), (4, "only in second")]


def test_limits(spark):
    times = {"0.25 s": 250, "3 SECS": 3000, "12msec": 12, "0.5 ms": 0, "1.5ms": 2, "limit 7 of 40 seconds": 40_000, "5 sections": None, "": None, None: None}
    sizes = {"64MB": 64, "0.5 GiB": 512, "2 gigabytes": 2048, "1 kib": 1, "4096kilobytes": 4, "3 of 16 mib": 16, "9 mbit": None, None: None}
    df = spark.createDataFrame([(t,) for t in {**times, **sizes}], "t string")
    got = {r.t: (r.ms, r.mb) for r in df.select("t", X.parse_quantity(F.col("t"), X.TIME_UNITS).alias("ms"), X.parse_memory(F.col("t")).alias("mb")).collect()}
    assert {t: got[t][0] for t in times} == times and {t: got[t][1] for t in sizes} == sizes


def test_counters_of_texts_counted_by_hand(spark):
    names = ["n_chars", "n_words", "n_lines", "n_numbers", "n_integers", "n_floats", "n_inequalities", "n_maths", "n_constraint_words", "n_big_o", "n_uppercase", "n_one_letter", "n_latex", "n_code"]
    counted = {
        "": [0] * 14,
        "Two words": [9, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
        "A line\nand 2 more\n": [18, 5, 2, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0],
        "x_1 = -3 + 4.5; y <= 7.0": [24, 7, 1, 4, 2, 2, 1, 4, 0, 0, 0, 1, 0, 1],
        "O(n log n) or O (k), not FOO(z)": [31, 10, 1, 0, 0, 0, 0, 0, 0, 2, 1, 6, 0, 3],
        "Limits: at most 5 INTEGERS, sum >= 10": [37, 7, 1, 2, 2, 0, 1, 1, 4, 0, 1, 0, 0, 1],
        "f(x) a[0] p->q A::B $e^x$ \\pi": [29, 11, 1, 1, 1, 0, 1, 2, 0, 0, 0, 9, 2, 4],
        "don't re-use": [12, 2, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0],
        "a\r\nb\x0bc\n1.2.3": [12, 6, 4, 2, 1, 1, 0, 0, 0, 0, 0, 3, 0, 0],
        "summit sum-total -- '' É ÀB": [27, 4, 1, 0, 0, 0, 0, 3, 1, 0, 0, 0, 0, 0],
    }
    texts = list(counted)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(v.alias(k) for k, v in X.text_counters(F.col("t")).items())).collect()
    for r in got:
        assert dict(zip(names, counted[texts[r.i]])) == {k: r[k] for k in names}, texts[r.i]


def test_counters_and_flags_of_words_of_a_million_letters(spark):
    n = 1_000_000
    texts = ["a" * n, "é-" * (n // 2), "'" * n, "-" * n, "1" * n, "_" * n + "(", "A" * n + " sum", "x " * (n // 2), "\n" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r for r in df.select("i", *(v.alias(k) for k, v in (X.text_counters(F.col("t")) | X.keyword_flags(F.col("t"))).items())).collect()}
    assert [got[i].n_words for i in range(len(texts))] == [1, 1, 0, 0, 1, 1, 2, n // 2, 0]
    assert all(got[i].n_chars == len(t) for i, t in enumerate(texts))
    assert (got[4].n_numbers, got[4].n_floats, got[3].n_maths, got[5].n_code, got[6].n_uppercase, got[6].n_constraint_words, got[7].n_one_letter, got[8].n_lines) == (1, 0, n, 1, 1, 1, n // 2, n)


def test_text_cleaning(spark):
    flat = lambda s: one(spark, v=X.strip_html(F.lit(s))).v
    assert flat("<p>Hello <b>world</b>&nbsp;!</p>") == "Hello world !"
    assert flat("a&nbsp;&le;&nbsp;b\n  and x ≥ y") == "a <= b and x >= y"
    assert one(spark, v=X.strip_html(F.lit("<p>a</p><script>x<y</script><p> b </p>"), True)).v == "a\nb"
    assert one(spark, v=X.strip_html(F.lit(None).cast("string"))).v == ""
    assert one(spark, v=N.safe_key(F.lit(1791), F.lit("C+"))).v == "1791_C.html"
    assert one(spark, v=X.drop_title(F.lit("Input: n and m"), "Input")).v == "n and m"
    flags = one(spark, **X.keyword_flags(F.lit("BITWISE sums of a list; shortest  path, Floyd!")))
    assert {k for k, v in flags.asDict().items() if v} == {"binary", "array", "shortest_path"} and len(flags) == 13


def test_statement_sections(spark):
    page = """<html><body><div class="menu">skip</div><div class="problem-statement"><div class="header"><div class="title">A. Sum</div>
    <div class="time-limit">2 seconds</div></div><div><p>Add &lt;two&gt; numbers.</p></div><div class="input-specification"><div class="section-title">Input</div><p>n</p></div>
    <div class="sample-tests"><div class="input">1</div><div class="output">2</div></div><div class="note"><p>Easy.</p></div></div></body></html>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "no markup")], "k long, html string")
    got = {r.k: r for r in X.extract_sections(df, "k", "html", X.STATEMENT).collect()}
    r = got[1]
    assert (r.title, r.time_limit, r.input, r.note, r.examples) == ("A. Sum", "2 seconds", "n", "Easy.", "1 2") and r.text == "Add <two> numbers."
    assert got[2].title == "" and got[3].text == ""
    after = [(1, page.replace("</body>", "<div>footer <p>more</p></div></body>")), (2, '<p class="problem-statement">a<div>b</p>c'), (3, '<br class="problem-statement">x')]
    last = {r.k: (r.text, r.paragraphs) for r in X.extract_sections(spark.createDataFrame(after, "k long, html string"), "k", "html", X.STATEMENT).collect()}
    assert last == {1: (r.text, r.paragraphs), 2: ("a b", 1), 3: ("", 0)}
    samples, blocks = X.sample_counts(F.col("html"))
    assert df.select(samples.alias("s"), blocks.alias("b")).first() == (1, 2)


def test_contents_and_statuses(spark):
    kind = lambda c, p: one(spark, v=FS.classify_content(F.lit(c), F.lit(p))).v
    assert [kind(b"", "a.html"), kind(b"%PDF-1.4", "a"), kind(b"  <!DOCTYPE html>", "a"), kind(b"x", "a.htm"), kind(b"x", "a.bin")] == ["empty", "pdf", "html", "html", "other"]
    assert one(spark, v=X.page_status(F.lit(None).cast("string"), F.lit("html"), F.lit("x"))).v == "missing"


def test_prediction_range(spark):
    v, lo, hi = one(spark, **dict(zip("vlh", S.prediction_range(F.lit(1250.0), F.lit(10.0)))))
    assert (v, lo, hi) == (1200.0, 1200.0, 1300.0)
    v, lo, hi = one(spark, **dict(zip("vlh", S.prediction_range(F.lit(5000.0), F.lit(300.0)))))
    assert v == lo == hi == 3500.0
