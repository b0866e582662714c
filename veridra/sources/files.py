"""Reading and writing: pruned scans, JSON snapshots, metric files, manifests of contents, exclusive sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A columnar scan of an allow-list; nothing else is read."""
    return spark.read.parquet(path).select(*columns)


def scan_snapshot(spark: SparkSession, path: str, schema: str, arrays: dict[str, str], lines: bool = False) -> dict[str, DataFrame]:
    """A nested JSON snapshot (one object a file, or with `lines` one a line) to one frame per array: name -> array path."""
    payload = spark.read.schema(schema).json(path, multiLine=not lines)
    return {name: payload.select(F.inline(where)) for name, where in arrays.items()}


def check_envelope(df: DataFrame, status: str, result: str) -> DataFrame:
    """(accepted, rejected): payloads whose status is OK and that hold a result, and the others."""
    ok = F.coalesce((F.col(status) == "OK") & F.col(result).isNotNull(), F.lit(False))
    return df.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def record_counts(df: DataFrame, arrays: list[str]) -> DataFrame:
    """(array, records) summed over payloads; a missing array has none."""
    return df.agg(*(F.coalesce(F.sum(F.greatest(F.size(a), F.lit(0))), F.lit(0)).alias(a) for a in arrays)).unpivot([], arrays, "array", "records")


def scan_metrics(spark: SparkSession, paths: dict[str, str], schema: str, numbers: list[str]) -> DataFrame:
    """Metric CSV files, one per strategy, united; numbers that cannot be read become null."""
    out = None
    for strategy, path in paths.items():
        one = spark.read.csv(path, schema=schema, header=True).withColumn("strategy", F.lit(strategy))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def classify_content(content: Column, path: Column) -> Column:
    """empty, pdf, html or other: by how the first 4096 bytes begin, a byte-order mark and white space aside, and by the file's suffix."""
    head = F.lower(F.regexp_replace(F.substring(content, 1, 4096).cast("string"), r"^[\x{FEFF} \t\r\n]+", ""))
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    pdf = head.startswith("%pdf-") | (suffix == "pdf")
    # How pages begin.
    html = head.startswith("<!doctype html") | head.startswith("<html") | head.startswith("<head") | head.startswith("<body") | suffix.isin("html", "htm")
    return F.when(F.octet_length(content) == 0, "empty").when(pdf, "pdf").when(html, "html").otherwise("other")


def content_manifest(files: DataFrame, path: str, content: str, modified: str | None = None) -> DataFrame:
    """(relative_path, sha256, size_bytes, kind[, mtime_utc]) of every file, given as path and bytes."""
    made = [F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"), classify_content(F.col(content), F.col(path)).alias("kind")]
    if modified:
        made.append(F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime_utc"))
    return files.select(F.col(path).alias("relative_path"), *made)


def files_below(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The tree's files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def work_list(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Distinct keys, numbers in numeric order before texts, nulls last; the first `limit` if given."""
    order = [x for k in keys for x in (F.col(k).try_cast("double").asc_nulls_last(), F.col(k).cast("string").asc_nulls_last())]
    out = df.select(*keys).dropDuplicates(keys).orderBy(*order)
    return out.limit(limit) if limit is not None else out


def sink(df: DataFrame, path: str, fmt: str = "parquet", exclusive: bool = False, by: list[str] | None = None) -> DataFrame:
    """Write and read back. Arrays become JSON text in CSV files. With `exclusive` an existing result is an error."""
    if fmt == "csv":
        df = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))})
    writer = df.write.mode("errorifexists" if exclusive else "overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
    reader = df.sparkSession.read.schema(df.schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
