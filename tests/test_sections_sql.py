"""The SQL of the page sections reads entities by the parser's rule."""

import duckdb
import pytest

from veridra import registry

HEADS = ["a &amp; b &amp", "&amp&amp;x &ampy", "&lt;p&gt &quot", "it&#39;s &middot &copy", "&amp;lt; &le; &ge;", "&nbsp &nbsp;z"]


@pytest.mark.parametrize("name", ["extract_sections", "extract_text_fields", "section_lengths"])
def test_entities_cut_off_before_their_semicolon(spark, tmp_path, name):
    pages = [(i, f"http://x/{i}", f"<article><h1>{h}</h1><p>{h}<p>and {h}.</article>") for i, h in enumerate(HEADS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall())
