"""Pages over many deliveries: bounded state, repeats, late rows, restarts."""

from pyspark.sql import functions as F

from veridra.sources.workspace import new_path
from veridra.streaming.pages import incremental

KIND = "page_id long, html string, arrival timestamp"


def deliver(spark, path, hour, ids):
    rows = spark.createDataFrame([(i, f"page {i}") for i in ids], "page_id long, html string")
    rows.withColumn("arrival", F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour))).coalesce(1).write.mode("append").parquet(path)


def test_state_stays_flat_over_ten_deliveries_and_restarts(spark):
    path, out, mark = (new_path(spark, n) for n in ("incoming", "features", "stream"))
    schema = spark.createDataFrame([], KIND).schema
    state = []
    for hour in range(10):
        # forty new pages, and half of the last delivery once more
        deliver(spark, path, hour, [*range(40 * hour, 40 * hour + 40), *(range(40 * hour - 20, 40 * hour) if hour else [])])
        seen: list = []
        got = incremental(spark, path, schema, "page_id", lambda p: p.select("page_id", F.length("html").alias("n")), out, mark, "arrival", "2 hours", seen=seen)
        state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]))
    assert got.count() == 400 and got.select("page_id").distinct().count() == 400
    # the keys of two hours, of the batch before the watermark moved, and of the new batch
    assert len(set(state[5:])) == 1 and max(state) <= 5 * 40
    # nothing new: a restart adds nothing
    assert incremental(spark, path, schema, "page_id", lambda p: p.select("page_id", F.length("html").alias("n")), out, mark, "arrival", "2 hours").count() == 400
    # behind the watermark: dropped
    deliver(spark, path, 1, [9_001])
    assert incremental(spark, path, schema, "page_id", lambda p: p.select("page_id", F.length("html").alias("n")), out, mark, "arrival", "2 hours").count() == 400
    # long after: a new page of a known key
    deliver(spark, path, 20, [5])
    last = incremental(spark, path, schema, "page_id", lambda p: p.select("page_id", F.length("html").alias("n")), out, mark, "arrival", "2 hours")
    assert last.count() == 401 and last.filter("page_id = 5").count() == 2
