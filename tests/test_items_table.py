"""The table behind items and models: what it moves, and odd inputs."""

import re

import duckdb

from veridra.plans.base import oracle
from veridra.sources import adapters as A
from veridra.sources import workspace

D = "/root/testdata/sf0.001"


def test_one_table_serves_items_and_models_and_each_line_moves_twice(spark):
    workspace.forget(spark)
    A.items(spark, D), A.merged(spark, D), A.model_table(spark, D)
    assert len([k for k in workspace._TABLES if k[2] == D]) == 1
    plan = A._made_lines(spark, D).repartition(4, "group_id")._jdf.queryExecution().executedPlan().toString()
    # lines by part and by group, parts and groups once each; and no column that decides nothing
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4
    assert "l_shipdate" not in plan and "l_returnflag" not in plan


def test_odd_lines_parts_and_groups_equal_the_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"create table {t} as select * from '{D}/{t}.parquet'")
    con.execute("insert into part select p_partkey, p_name || ' again', p_brand, p_type, p_size, p_retailprice from part where p_partkey % 7 = 0")  # twice
    con.execute("delete from part where p_partkey % 5 = 0")  # lines without a part, first ones of their item among them
    con.execute("insert into lineitem select * from lineitem where l_orderkey % 3 = 0")
    con.execute("update lineitem set l_orderkey = null where l_orderkey % 13 = 0")
    con.execute("update lineitem set l_quantity = 2 where l_orderkey % 17 = 0")
    con.execute("delete from orders where o_orderkey % 4 = 0")
    con.execute("insert into orders select * from orders where o_orderkey % 9 = 0")
    for t in ("lineitem", "part", "orders"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    plain = "group_id, line_no, item_code, item_name, item_type, label, points, popularity, group_type, phase, start_time"
    want = con.sql(oracle(f"SELECT {plain}, array_to_string(tags, '|') AS tags FROM merged")).fetchall()
    got = A.merged(spark, str(tmp_path)).selectExpr(*plain.split(", "), "array_join(tags, '|') AS tags").collect()
    assert len(got) > 1000
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    workspace.forget(spark)
