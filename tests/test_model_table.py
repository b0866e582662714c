"""Tables that a session makes once."""

from pyspark.sql import functions as F

from veridra.plans import q_models
from veridra.sources import adapters as A
from veridra.sources.workspace import forget, made_once, scratch, stored

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_the_model_table_is_read_in_buckets_of_groups(spark):
    rows = A.model_table(spark, D)
    assert "Window" not in plan(rows) and "lineitem" not in plan(rows)
    by_group = plan(rows.groupBy("group_id").agg(F.count("*")))
    assert "Exchange" not in by_group
    small = rows.select("group_id").distinct().withColumn("x", F.lit(1))
    assert "Exchange" not in plan(rows.join(small.hint("merge"), "group_id"))
    assert A.model_table(spark, D).select("group_id").count() == A._model_table(spark, D).count()


def test_both_splits_have_every_row_once(spark):
    rows = q_models.both_splits(spark, D)
    assert rows.groupBy("strategy").count().filter(f"count <> {A.model_table(spark, D).count()}").count() == 0


def test_tables_are_made_once_until_they_are_forgotten(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(10).withColumn("v", F.col("id") * 2)

    for _ in range(3):
        assert made_once(spark, "ten", "nowhere", make, "id", ["id"]).agg(F.sum("v")).first()[0] == 90
    assert len(made) == 1
    forget(spark)
    made_once(spark, "ten", "nowhere", make, "id", ["id"])
    assert len(made) == 2
    forget(spark)


def test_scratch_files_go_at_the_end(spark):
    with scratch(spark):
        inside = stored(spark.range(5))
        assert inside.count() == 5
        files = inside.inputFiles()
    outside = stored(spark.range(5))
    assert outside.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    exists = lambda f: path(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(f))
    assert not any(map(exists, files)) and all(map(exists, outside.inputFiles()))
