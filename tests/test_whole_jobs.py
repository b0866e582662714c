"""Queries that once did less than the whole job, against the whole job."""

import duckdb
import pytest

from veridra import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer orders lineitem part pages documents labels events".split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def whole(name, cut, full):
    """The registered SQL, and no cut in it."""
    assert cut not in registry.oracle_sql()[name]
    return registry.oracle_sql()[name].replace(cut, full)


def rows(df, order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def test_every_order_gets_its_text(spark, duck):
    want = duck.sql(f"select item, available, n from ({whole('text_record_assembly', ' WHERE o_orderkey < 500', '')})").fetchall()
    got = rows(registry.queries()["text_record_assembly"](spark, D), ["item", "available", "n"])
    assert len(got) == duck.sql("select count(*) from orders").fetchall()[0][0] > 500
    assert got == sorted(want)


def test_tfidf_has_the_whole_vocabulary(spark, duck, monkeypatch):
    from veridra.plans import q_text

    want = duck.sql(f"select doc_id, n_terms, first_term, top_weight from ({whole('tfidf', 'LIMIT 2000)', 'LIMIT 20000)')})").fetchall()
    got = rows(registry.queries()["tfidf"](spark, D), ["doc_id", "n_terms", "first_term", "top_weight"])
    assert [r[:3] for r in got] == sorted(r[:3] for r in want)
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], abs=2e-6)
    assert q_text.weights(spark, D).select("term").distinct().count() > 2000
    seen, tfidf = [], q_text.X.tfidf
    monkeypatch.setattr(q_text.X, "tfidf", lambda *a, **k: seen.append(tfidf(*a, **k).select("term").distinct().count()) or tfidf(*a, **k))
    assert q_text.study_rows(spark, D)[0].count() > 0
    assert seen[0] > 2000


def test_text_studies_equal_closed_forms(spark):
    import numpy as np

    from veridra.plans import q_text

    rows, n_terms = q_text.study_rows(spark, D)
    rows = rows.collect()
    got = {(r.setting, r.part): r for r in registry.queries()["tfidf_ridge"](spark, D).collect()}
    assert {s for s, _ in got} == set(q_text.SETTINGS) and len(got) == 14
    y, train = np.array([r.label for r in rows]), np.array([r.part == "train" for r in rows])
    cats = lambda c: sorted({r[c] or "__missing__" for r, t in zip(rows, train) if t})
    light = np.array([[float(r[c]) for c in q_text.LIGHT] for r in rows])
    blocks = {
        "metadata": np.array([[float((r[c] or "__missing__") == v) for c in ("lang", "source") for v in cats(c)] for r in rows]),
        "text_light": (light - light[train].mean(axis=0)) / light[train].std(axis=0),
        "tfidf": np.array([np.bincount(r.terms, weights=r.weights, minlength=n_terms) for r in rows]),
    }
    for setting, parts in q_text.SETTINGS.items():
        x = np.hstack([blocks[p] for p in parts])
        centre = x[train].mean(axis=0)
        z = x[train] - centre
        # the dual form: as many unknowns as rows
        w = z.T @ np.linalg.solve(z @ z.T + np.eye(len(z)), y[train] - y[train].mean())
        e = np.abs((x - centre) @ w + y[train].mean() - y)
        for part, rows_of in (("train", train), ("test", ~train)):
            r = got[setting, part]
            assert r.n == rows_of.sum() and abs(r.mae - e[rows_of].mean()) < 2e-3, (setting, part, r.mae, e[rows_of].mean())


def test_bootstrap_draws_whole_groups_ten_thousand_times(spark, duck):
    sql = whole("paired_cluster_bootstrap", "group_id % 50", "group_id").replace("range(200)", "range(10000)")
    names = ["estimate", "low", "high", "clusters", "reps"]
    (want,) = duck.sql(f"select {', '.join(names)} from ({sql})").fetchall()
    (got,) = rows(registry.queries()["paired_cluster_bootstrap"](spark, D), names)
    assert got[3] > 50 and got[4] == 10_000
    assert got == pytest.approx(want, abs=2e-4)


@pytest.mark.parametrize(("name", "size"), [("random_forest", (100, 8)), ("gradient_boosting", (160, 4)), ("evaluate_grid_metrics", (100, 8))])
def test_models_have_their_full_size(spark, monkeypatch, name, size):
    from veridra.plans import q_models

    class Seen(Exception):
        pass

    def capture(df, specs, *rest):
        raise Seen([s.estimator("x", "label") for s in specs])

    monkeypatch.setattr(q_models.R, "evaluate_grid", capture)
    with pytest.raises(Seen) as seen:
        registry.queries()[name](spark, D)
    for e in seen.value.args[0]:
        assert (e.getMaxIter() if name == "gradient_boosting" else e.getNumTrees(), e.getMaxDepth()) == size


@pytest.mark.parametrize(("name", "cut", "order"), [("tag_one_hot", " ORDER BY df DESC, term LIMIT 5", ["column", "ones"]), ("one_hot_inverse", " ORDER BY df DESC, term LIMIT 5", ["group_id", "line_no", "tags"]), ("page_work_list", " LIMIT 12", ["item_code", "line_no"])])
def test_all_tags_and_keys_come_back(spark, duck, name, cut, order):
    want = duck.sql(f"""select {', '.join(f'"{c}"' for c in order)} from ({whole(name, cut, '')})""").fetchall()
    assert rows(registry.queries()[name](spark, D), order) == sorted(want)


def test_ablation_equals_closed_forms(spark):
    import numpy as np

    from veridra.plans import q_models

    rows = q_models.P.time_split(q_models.A.model_table(spark, D), "start_time", q_models.RATIOS).collect()
    y, train = np.array([float(r.label) for r in rows]), np.array([r.split_name == "train" for r in rows])
    scaled = lambda c: (lambda v: (v - v[train].mean()) / (v[train].std() or 1.0))(np.array([float(r[c]) for r in rows]))
    letters = sorted({r.index_letter for r, t in zip(rows, train) if t})
    terms = sorted({x for r, t in zip(rows, train) if t for x in r.tags})
    blocks = {
        "index": np.column_stack([scaled("index_rank"), scaled("index_number"), *(np.array([float(r.index_letter == x) for r in rows]) for x in letters)]),
        "solved": np.column_stack([scaled("log_popularity"), scaled("popularity_missing")]),
        "points": np.column_stack([scaled("points"), scaled("has_points")]),
        "tags": np.array([[float(x in r.tags) for x in terms] for r in rows]),
    }
    got = {(r.feature_set, r.split_name): r for r in registry.queries()["ablation_sets"](spark, D).filter("strategy = 'forward'").collect()}
    assert len(got) == 3 * len(q_models.ABLATION)
    for name, groups in q_models.ABLATION.items():
        x = np.hstack([blocks[g] for g in groups])
        z = x[train] - x[train].mean(axis=0)
        w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y[train] - y[train].mean()))
        e = np.abs((x - x[train].mean(axis=0)) @ w + y[train].mean() - y)
        for split in ("train", "valid", "test"):
            at = np.array([r.split_name == split for r in rows])
            assert got[name, split].n == at.sum() and abs(got[name, split].mae - e[at].mean()) < 1e-2 * max(1.0, e[at].mean() / 1e4), (name, split)
    ranks = {r.feature_set: r.validation_rank for r in got.values()}
    assert sorted(ranks.values()) == list(range(1, 10))
    assert min(ranks, key=ranks.get) == min((got[s, "valid"].mae, s) for s in ranks)[1]


def test_boosted_ablation_equals_models_fitted_alone(spark):
    from veridra.operators import metrics as M
    from veridra.operators import models as R
    from veridra.plans import q_models

    found = registry.queries()["ablation_boosting"](spark, D).collect()
    got = {(r.strategy, r.feature_set, r.split_name): r for r in found}
    assert len(got) == len(found) == 2 * 3 * len(q_models.ABLATION)
    for name in ("solved", "points"):
        spec = R.ModelSpec(name, tuple(q_models.GROUPS[name]), R.gradient_boosting())
        long = R.evaluate_grid(q_models.forward_split(spark, D), [spec], "label", q_models.A.KEYS)
        for r in M.regression_metrics(long, "actual", "predicted", ["split_name"], q_models.BANDS).collect():
            own = got["forward", name, r.split_name]
            assert own.n == r.n and abs(own.mae - r.mae) < 1e-3 and abs(own.rmse - r.rmse) < 1e-3
            assert abs(own.mae_over_all - (own.mae - got["forward", "all", r.split_name].mae)) < 1e-3
    for strategy in ("forward", "grouped"):
        errors = sorted((got[strategy, s, "valid"].mae, s) for s in q_models.ABLATION)
        assert [got[strategy, s, "test"].validation_rank for _, s in errors] == list(range(1, 10))
