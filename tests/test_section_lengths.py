"""Lengths of all sections of a page, not of its title alone."""

from pyspark.sql import functions as F

from veridra import registry
from veridra.functions import text as X
from veridra.plans import q_text
from veridra.sources import adapters as A

D = "/root/testdata/sf0.001"


def test_every_section_is_measured(spark):
    names = list(dict.fromkeys([*X.ARTICLE.sections.values(), "text"]))
    rows = registry.queries()["section_lengths"](spark, D)
    assert rows.columns == ["page_id", *(c for s in names for c in (f"{s}_length", f"has_{s}"))]
    got = {r.page_id: tuple(r)[1:] for r in rows.collect()}
    for r in X.extract_sections(A.pages(spark, D), "page_id", "html", X.ARTICLE).collect():
        assert got[r.page_id] == tuple(x for s in names for x in (len(r[s]), int(len(r[s]) > 0)))
    # most of a page's text is in its body
    total = rows.agg(F.sum("title_length").alias("title"), F.sum("body_length").alias("body")).first()
    assert total.body > 10 * total.title


def test_items_and_loose_text_are_sections_too(spark, tmp_path):
    pages = [(1, "u", "<article><h1>ab</h1>loose<p>body text</p><ul><li>one<li>two</ul></article>out"), (2, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in registry.queries()["section_lengths"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1, 9, 1, 7, 1, 5, 1), 2: (0,) * 8}
    assert list(q_text.LENGTHS_SQL) == ["title", "body", "items", "text"]
