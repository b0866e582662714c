"""Every query with an oracle against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from veridra import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def cells(row):
    out = []
    for x in row:
        if x is None or (isinstance(x, float) and math.isnan(x)):
            out.append("")
        elif isinstance(x, (bool, int, float)) or hasattr(x, "as_tuple"):
            out.append(f"{float(x):.9g}")
        else:
            out.append(str(x))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_the_oracle(spark, duck, name):
    df = registry.queries()[name](spark, D)
    rel = duck.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted(cells(r) for r in df.select(*order).collect())
    want = sorted(cells([r[rel.columns.index(c)] for c in order]) for r in rel.fetchall())
    assert got == want
    spark.catalog.clearCache()


def test_other_queries_have_rows(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, D).count() > 0, name
        spark.catalog.clearCache()
