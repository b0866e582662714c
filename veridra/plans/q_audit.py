"""Queries over manifests, digests, fingerprints and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridra.functions import text as X
from veridra.operators import checks as K
from veridra.operators import metrics as M
from veridra.plans.base import query
from veridra.plans.q_tables import KIND_SQL, PAGE_HEADS
from veridra.sources import adapters as A
from veridra.sources import files as S
from veridra.sources.workspace import new_path
from veridra.streaming.pages import incremental


def manifest(spark, d):
    return S.content_manifest(A.pages(spark, d).withColumn("path", F.concat("page_id", F.lit(".html"))).withColumn("content", F.col("html").cast("binary")), "path", "content")


@query("manifest_summary", f"SELECT count(*) AS entries, sum(strlen(html)) AS bytes, count(*) FILTER ({KIND_SQL} = 'html') AS html, 0 AS pdf, 0 AS empty FROM {PAGE_HEADS}")
def _(spark, d):
    return M.manifest_summary(manifest(spark, d), ["html", "pdf", "empty"]).drop("digest")


@query("manifest_validate", "SELECT page_id || '.html' AS relative_path, 'bad size' AS problem FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT '../' || page_id || '.html', 'unsafe path' FROM pages WHERE page_id % 4 = 2 UNION ALL SELECT page_id || '.html', 'bad digest' FROM pages WHERE page_id % 4 = 3 UNION ALL SELECT page_id || '.html', 'duplicate path' FROM pages, range(2) WHERE page_id % 100 = 0")
def _(spark, d):
    k = F.regexp_extract("relative_path", r"(\d+)", 1).cast("int") % 4
    rows = manifest(spark, d).withColumn("k", k)
    broken = rows.withColumn("size_bytes", F.when(F.col("k") == 1, -1).otherwise(F.col("size_bytes"))).withColumn("sha256", F.when(F.col("k") == 3, "x").otherwise(F.col("sha256"))).withColumn("relative_path", F.when(F.col("k") == 2, F.concat(F.lit("../"), "relative_path")).otherwise(F.col("relative_path")))
    return K.manifest_problems(broken.union(broken.filter(F.regexp_extract("relative_path", r"(\d+)", 1).cast("int") % 100 == 0)))


CHANGES = "SELECT page_id || '.html' AS relative_path, CASE page_id % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'sha256' END AS problem FROM pages WHERE page_id % 4 IN (1, 2) UNION ALL SELECT 'new' || page_id, 'extra' FROM pages WHERE page_id % 4 = 3"


@query("manifest_diff", CHANGES)
def _(spark, d):
    rows = manifest(spark, d)
    k = F.regexp_extract("relative_path", r"(\d+)", 1).cast("int") % 4
    current = rows.filter(k != 1).withColumn("sha256", F.when(k == 2, "0").otherwise(F.col("sha256")))
    extra = rows.filter(k == 3).withColumn("relative_path", F.concat(F.lit("new"), F.regexp_extract("relative_path", r"(\d+)", 1)))
    return K.manifest_diff(rows, current.union(extra))


@query("hash_manifest_check", "SELECT 'altered' AS relative_path, 'sha256' AS problem UNION ALL SELECT 'gone', 'missing'")
def _(spark, d):
    """Artifacts written as files, of some megabytes each, are listed, then checked against what lies there now."""
    path = new_path(spark, "artifacts")
    pages = A.pages(spark, d).select("html")
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    pages.repartition(max(4, -(-size // (16 * 2**20)))).write.text(path, lineSep="\n")
    found = S.files_below(spark, path, "part-*").withColumn("name", F.element_at(F.split("path", "/"), -1))
    now = S.content_manifest(found, "name", "content")
    first = now.agg(F.min("relative_path")).first()[0]
    listed = now.withColumn("altered", F.col("relative_path") == first).withColumn("sha256", F.when(F.col("altered"), "0").otherwise(F.col("sha256")))
    gone = listed.filter("altered").withColumn("relative_path", F.lit("gone"))
    diff = K.manifest_diff(listed.union(gone).drop("altered"), now)
    return diff.withColumn("relative_path", F.when(F.col("relative_path") == "gone", "gone").otherwise("altered"))


@query("fingerprint_column", "SELECT group_id, line_no, sha256('ratios=70/15/15;seed=42') AS config_fingerprint FROM items")
def _(spark, d):
    import hashlib

    mark = hashlib.sha256(b"ratios=70/15/15;seed=42").hexdigest()
    return K.assert_fingerprint(K.stamp(A.items(spark, d).select(*A.KEYS), mark), mark)


@query("incremental_pages", "SELECT page_id, length(html) AS n_html, strlen(html) AS n_bytes, len(regexp_extract_all(html, '\\d+(?:\\.\\d+)?')) AS n_numbers FROM pages")
def _(spark, d):
    """Three deliveries an hour apart, each of which repeats part of the one before; the stream's rows equal the batch's. A key is remembered for two
    hours of arrival."""
    path, out, mark = (new_path(spark, n) for n in ("incoming", "features", "stream"))
    rows = A.pages(spark, d)

    def features(pages):
        c = X.text_counters(F.col("html"))
        return pages.select("page_id", c["n_chars"].alias("n_html"), F.octet_length("html").alias("n_bytes"), c["n_numbers"].alias("n_numbers"))

    deliveries = ("page_id % 3 = 0", "page_id % 3 = 1 or page_id % 12 = 0", "page_id % 3 = 2 or page_id % 12 = 1")
    for hour, which in enumerate(deliveries):
        delivery = rows.filter(which).withColumn("arrival", F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour)))
        delivery.write.mode("append").parquet(path)
        got = incremental(spark, path, delivery.schema, "page_id", features, out, mark, "arrival", "2 hours")
    return got.drop("processed")
