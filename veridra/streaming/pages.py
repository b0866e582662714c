"""Pages as they arrive: a file stream to the same features as the batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(
    spark: SparkSession, path: str, schema, key: str, features: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, arrival: str, delay: str = "1 hour", files: int | None = None, seen: list | None = None
) -> DataFrame:
    """Read new page files, drop keys that arrived before, append the features of the others, and return what has been written. Each run takes what is
    there, `files` at a time where given, and stops; the checkpoint makes a restart go on where it ended.

    A key is remembered until the watermark, the latest `arrival` less `delay`, has passed it, so the state holds the keys of one delay and not of all
    time. A repeat within the delay is dropped, and so are rows that arrive behind the watermark; a key that comes again later is a new page.
    Each batch's progress goes to `seen`.
    """
    reader = spark.readStream.schema(schema)
    pages = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    once = pages.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([key])
    query = features(once).withColumn("processed", F.lit(True)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if seen is not None:
        seen.extend(query.recentProgress)
    return spark.read.parquet(out)
