"""Queries over scans, sinks, column work and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridra.operators import checks as K
from veridra.operators import normalize as N
from veridra.operators.encode import array_dictionary, decode_array, encode_array
from veridra.plans.base import query
from veridra.sources import adapters as A
from veridra.sources import files as S
from veridra.sources.workspace import new_path, stored


@query("scan_parquet_pruned", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    return S.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus"])


@query("scan_json_snapshot", """SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS bigint)) AS k FROM events GROUP BY 1""")
def _(spark, d):
    """Events as nested JSON, about a thousand to a payload: a user with many events has several payloads."""
    events = A.table(spark, d, "events").select("user_id", "event_type", "props")
    sizes = events.groupBy("user_id").agg(F.ceil(F.count("*") / 1000).cast("int").alias("payloads"))
    part = F.pmod(F.xxhash64("event_type", "props", F.monotonically_increasing_id()), "payloads").alias("part")
    event = F.struct("event_type", F.from_json("props", "k long").alias("props"))
    payload = events.join(sizes.hint("merge"), "user_id").select("user_id", part, event.alias("event")).groupBy("user_id", "part").agg(F.lit("OK").alias("status"), F.struct(F.collect_list("event").alias("events")).alias("result"))
    path = new_path(spark, "snapshot")
    payload.drop("part").write.json(path)
    parts = S.scan_snapshot(spark, path, "user_id long, status string, result struct<events:array<struct<event_type:string,props:struct<k:long>>>>", {"events": "result.events"}, lines=True)
    flat = N.flatten(parts["events"])
    return flat.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("props_k").alias("k"))


@query("envelope_check", "SELECT count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 1000) AS accepted, count(*) FILTER (NOT (o_orderstatus = 'O' AND o_totalprice > 1000)) AS rejected FROM orders")
def _(spark, d):
    env = A.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "OK").otherwise("FAILED").alias("status"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("result"))
    return S.check_envelope(env, "status", "result")


@query("record_counts", "SELECT 'tags' AS array, sum(len(tags)) AS records FROM items UNION ALL SELECT 'lines', count(*) FROM items")
def _(spark, d):
    payload = A.items(spark, d).select("tags", F.array("line_no").alias("lines"))
    return S.record_counts(payload, ["tags", "lines"])


@query("scan_csv_metrics", """SELECT strategy, model_name, split_name, round(mae, 4) AS mae FROM metrics""")
def _(spark, d):
    from veridra.plans.q_models import metrics

    rows = metrics(spark, d).select("strategy", "model_name", "split_name", F.round("mae", 4).cast("string").alias("mae"))
    paths = {}
    for s in ("forward", "grouped"):
        paths[s] = new_path(spark, "metrics")
        rows.filter(F.col("strategy") == s).drop("strategy").write.csv(paths[s], header=True)
    return S.scan_metrics(spark, paths, "model_name string, split_name string, mae string", ["mae"]).select("strategy", "model_name", "split_name", "mae")


@query("scan_predictions", "SELECT strategy, model_name, count(*) AS n, round(sum(actual), 2) AS actual FROM predictions GROUP BY 1, 2")
def _(spark, d):
    from veridra.plans.q_models import predictions

    path = new_path(spark, "predictions")
    kept = S.sink(predictions(spark, d), path, by=["strategy"])
    return kept.groupBy("strategy", "model_name").agg(F.count("*").alias("n"), F.round(F.sum("actual"), 2).alias("actual"))


SUFFIX_SQL = "lower(regexp_extract(url, '[^/]\\.([^./]+)$', 1))"
KIND_SQL = f"""CASE WHEN strlen(html) = 0 THEN 'empty' WHEN starts_with(h, '%pdf-') OR {SUFFIX_SQL} = 'pdf' THEN 'pdf'
  WHEN regexp_matches(h, '^(?:<!doctype html|<html|<head|<body)') OR {SUFFIX_SQL} IN ('html', 'htm') THEN 'html' ELSE 'other' END"""
PAGE_HEADS = "(SELECT *, lower(ltrim(substr(html, 1, 4096), chr(65279) || ' ' || chr(9) || chr(13) || chr(10))) AS h FROM pages)"


@query("content_manifest", f"SELECT url AS relative_path, sha256(html) AS sha256, strlen(html) AS size_bytes, {KIND_SQL} AS kind FROM {PAGE_HEADS}")
def _(spark, d):
    return S.content_manifest(A.pages(spark, d).withColumn("content", F.col("html").cast("binary")), "url", "content")


# How some pages are made to begin, under which name, and what they are then.
BEGINNINGS = (("\ufeff\n <HEAD>", "a.txt", "html"), (" \t%PDF-1.4", "a", "pdf"), ("text <html>", "b.bin", "other"), ("<!DOCTYPE html>", "c/d.PDF", "pdf"), ("plain", "d.htm", "html"), ("\r\n<body>", ".html", "html"), ("x", "e/.html", "other"), ("<p>", "f.html.txt", "other"))


@query("classify_content", "SELECT page_id, CASE WHEN page_id % 9 = 8 THEN 'empty' ELSE [" + ", ".join(f"'{k}'" for *_, k in BEGINNINGS) + "][page_id % 9 + 1] END AS kind FROM pages")
def _(spark, d):
    at = (F.col("page_id") % 9 + 1).cast("int")
    begin, name = (F.get(F.array(*(F.lit(x[i]) for x in BEGINNINGS)), at - 1) for i in (0, 1))
    content = F.when(at == 9, F.lit("")).otherwise(F.concat(begin, "html")).cast("binary")
    return A.pages(spark, d).select("page_id", S.classify_content(content, F.coalesce(name, F.lit("g.html"))).alias("kind"))


@query("page_work_list", "SELECT DISTINCT item_code, line_no FROM items ORDER BY try_cast(item_code AS double) NULLS LAST, item_code, line_no")
def _(spark, d):
    return S.work_list(A.items(spark, d), ["item_code", "line_no"])


SINK_SQL = "SELECT group_id, line_no, item_code, array_to_string(tags, '|') AS tags FROM items"


@query("sink_parquet", SINK_SQL)
def _(spark, d):
    return S.sink(A.items(spark, d).select("group_id", "line_no", "item_code", "tags"), new_path(spark, "sink")).withColumn("tags", F.array_join("tags", "|"))


@query("sink_csv_json", SINK_SQL)
def _(spark, d):
    rows = A.items(spark, d).select("group_id", "line_no", "item_code", "tags")
    csv = S.sink(rows, new_path(spark, "sink"), "csv").withColumn("tags", F.array_join(F.from_json("tags", "array<string>"), "|"))
    json = S.sink(rows, new_path(spark, "sink"), "json").withColumn("tags", F.array_join("tags", "|"))
    return csv.intersect(json)


@query("sink_exclusive", "SELECT phase, count(*) AS n FROM groups_ GROUP BY 1")
def _(spark, d):
    path = new_path(spark, "sink")
    kept = S.sink(A.groups(spark, d).groupBy("phase").agg(F.count("*").alias("n")), path, exclusive=True)
    try:
        S.sink(kept.limit(0), path, exclusive=True)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return kept


@query("snake_case_columns", "SELECT group_id, line_no, item_code AS item_code_2 FROM items")
def _(spark, d):
    return N.snake_case(A.items(spark, d).select(F.col("group_id").alias("groupId"), F.col("line_no").alias("Line No"), F.col("item_code").alias("itemCode-2")))


@query("flatten_struct", "SELECT group_id AS key_group_id, line_no AS key_more_line_no, label FROM items")
def _(spark, d):
    return N.flatten(A.items(spark, d).select(F.struct("group_id", F.struct("line_no").alias("more")).alias("key"), "label"))


@query("ensure_columns", "SELECT group_id, line_no, CAST(NULL AS double) AS weight, '' AS extra FROM items")
def _(spark, d):
    return N.ensure_columns(A.items(spark, d).select("group_id", "line_no"), {"weight": "double", "extra": "array<string>", "line_no": "int"}).withColumn("extra", F.array_join("extra", "|"))


@query("coerce_numeric", "SELECT 'index' AS \"column\", count(*) FILTER (try_cast(substr(item_code, 2) AS bigint) IS NULL) AS lost FROM items UNION ALL SELECT 'label', 0")
def _(spark, d):
    rows = A.items(spark, d).select(F.substring("item_code", 2, 9).alias("index"), F.col("label").cast("string").alias("label"))
    return N.coerce(rows, {"index": "long", "label": "double"})[1]


@query("order_columns", "SELECT line_no, group_id, item_code, label FROM items")
def _(spark, d):
    return N.order_columns(A.items(spark, d).select("label", "item_code", "group_id", "line_no"), ["line_no", "absent"])


@query("normalize_tags", "SELECT group_id, line_no, array_to_string(list_sort(list_distinct(list_filter(string_split(item_name, ' '), lambda x: x <> ''))), '|') AS tags FROM items")
def _(spark, d):
    raw = F.concat(F.split("item_name", " "), F.array(F.lit(" "), F.lit(None).cast("string"), F.element_at(F.split("item_name", " "), 1)))
    return A.items(spark, d).select("group_id", "line_no", F.array_join(N.norm_array(raw), "|").alias("tags"))


CODE = "regexp_extract(upper(item_code), '^([A-Z]+)', 1)"
NUMBER = "try_cast(regexp_extract(item_code, '(\\d+)$', 1) AS bigint)"


@query("index_features", f"SELECT DISTINCT item_code, {CODE} AS index_letter, coalesce({NUMBER}, 0) AS index_number, ascii(item_code) - 64 AS index_rank FROM items")
def _(spark, d):
    return N.code_features(A.items(spark, d).select("item_code"), "item_code").distinct()


@query("index_features_nullable", f"SELECT DISTINCT item_code, {CODE} AS index_letter, {NUMBER} AS index_number, ascii(item_code) - 64 AS index_rank FROM items")
def _(spark, d):
    return N.code_features(A.items(spark, d).select("item_code"), "item_code", "nullable").distinct()


@query("index_rank_base26", "SELECT DISTINCT p_type AS code, list_reduce([0::hugeint] || list_transform(list_filter(string_split(regexp_extract(p_type, '^([A-Z]{1,4})', 1), ''), lambda c: c <> ''), lambda c: ascii(c) - 64), lambda a, c: a * 26 + c)::bigint AS rank FROM part")
def _(spark, d):
    codes = A.table(spark, d, "part").select(F.col("p_type").alias("code")).distinct()
    return codes.select("code", N.code_parts(F.regexp_extract("code", "^([A-Z]{1,4})", 1), "base26")[2].cast("long").alias("rank"))


@query("missing_indicators", "SELECT group_id, line_no, coalesce(points, 0.0) AS points, CAST(points IS NOT NULL AS int) AS has_points, coalesce(popularity, 0) AS popularity, CAST(popularity IS NULL AS int) AS popularity_missing FROM merged")
def _(spark, d):
    rows = A.merged(spark, d).select("group_id", "line_no", "points", "popularity")
    return N.impute_flag(rows, {"points": "has_points"}, {"popularity": "popularity_missing"})


@query("missing_counts", "SELECT 'points' AS \"column\", count(*) - count(points) AS nulls FROM merged UNION ALL SELECT 'popularity', count(*) - count(popularity) FROM merged UNION ALL SELECT 'label', count(*) - count(label) FROM merged")
def _(spark, d):
    return N.null_counts(A.merged(spark, d), ["points", "popularity", "label"])


@query("log1p_feature", "SELECT group_id, line_no, round(ln(1 + popularity), 9) AS log_popularity FROM item_stats")
def _(spark, d):
    return A.item_stats(spark, d).select("group_id", "line_no", F.round(F.log1p("popularity"), 9).alias("log_popularity"))


@query("tag_count", "SELECT group_id, line_no, len(tags) AS tag_count FROM items")
def _(spark, d):
    return A.items(spark, d).select("group_id", "line_no", F.size("tags").cast("long").alias("tag_count"))


TERMS = "(SELECT term, count(*) AS df FROM (SELECT unnest(tags) AS term FROM items) GROUP BY 1)"


@query("tag_vocabulary", f"SELECT term, df FROM {TERMS} WHERE df >= (SELECT count(*) // 10 FROM items)")
def _(spark, d):
    rows = A.items(spark, d)
    return N.vocabulary(rows, "tags", rows.count() // 10)


@query("tag_column_names", f"SELECT term, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY term) = 1 THEN c ELSE c || '_' || substr(sha256(term), 1, 8) END AS \"column\" FROM (SELECT term, 'tag__' || trim(regexp_replace(lower(term), '[^a-z0-9]+', '_', 'g'), '_') AS c FROM (SELECT term FROM {TERMS} UNION ALL SELECT upper(term) || '!' FROM {TERMS}))")
def _(spark, d):
    terms = N.vocabulary(A.items(spark, d), "tags", 1).select("term")
    return N.safe_names(terms.union(terms.select(F.concat(F.upper("term"), F.lit("!"))))).select("term", "column")


@query("tag_one_hot", f"SELECT 'tag__' || term AS \"column\", df AS ones FROM {TERMS}")
def _(spark, d):
    rows = stored(A.items(spark, d).select(*A.KEYS, "tags"))
    words = array_dictionary(rows, "tags")
    ones = encode_array(rows, A.KEYS, "tags", words).select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("ones"))
    return N.safe_names(words).join(ones.hint("merge"), "place").select("column", "ones")


@query("one_hot_inverse", "SELECT group_id, line_no, array_to_string(tags, ';') AS tags FROM items")
def _(spark, d):
    rows = stored(A.items(spark, d).select(*A.KEYS, "tags"))
    words = array_dictionary(rows, "tags")
    back = decode_array(encode_array(rows, A.KEYS, "tags", words), A.KEYS, "places", words)
    return back.select(*A.KEYS, F.array_join("tags", ";").alias("tags"))


SYNONYMS = {"not specified": "none", "urgent": "high"}


@query("tag_normalize", "SELECT o_orderkey AS group_id, CASE c WHEN 'not specified' THEN 'none' WHEN 'urgent' THEN 'high' ELSE c END AS tag FROM (SELECT o_orderkey, lower(substr(o_orderpriority, 3)) AS c FROM orders)")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.translate(F.substring("group_type", 3, 40), " ", "_"))
    return A.groups(spark, d).select("group_id", N.canonical_tag(raw, SYNONYMS).alias("tag"))


@query("key_normalize", "SELECT l_orderkey AS a, CAST(l_orderkey AS varchar) AS as_int, CAST(l_orderkey AS varchar) AS as_float, CAST(l_orderkey AS varchar) AS as_text, l_returnflag AS code FROM lineitem")
def _(spark, d):
    k = F.col("l_orderkey")
    return A.table(spark, d, "lineitem").select(k.alias("a"), N.norm_key(k).alias("as_int"), N.norm_key(k.cast("double")).alias("as_float"), N.norm_key(F.concat(F.lit(" "), k.cast("string"), F.lit(".0 "))).alias("as_text"), N.norm_key(F.col("l_returnflag")).alias("code"))


@query("resolve_columns", "SELECT group_id, line_no AS index FROM items")
def _(spark, d):
    return N.standardize(A.items(spark, d).select(F.col("group_id").alias("contestId"), "line_no"), {"group_id": ["contest_id"], "index": ["line_no", "idx"]})


@query("derived_url_key", "SELECT DISTINCT item_code, item_name, 'https://example.org/' || replace(item_name, ' ', '%20') || '/' || item_code AS url, item_code || '_' || replace(item_name, ' ', '_') || '.html' AS file FROM items")
def _(spark, d):
    rows = A.items(spark, d).select("item_code", "item_name").distinct()
    return rows.select("item_code", "item_name", F.concat(F.lit("https://example.org/"), N.quoted(F.col("item_name")), F.lit("/"), N.quoted(F.col("item_code"))).alias("url"), N.safe_key(F.col("item_code"), F.concat(F.lit("."), F.col("item_name"))).alias("file"))


@query("snapshot_as_of", "SELECT max(start_time) AS as_of FROM groups_ UNION ALL SELECT 1700000000")
def _(spark, d):
    g = A.groups(spark, d)
    return N.snapshot_as_of(g, "start_time").union(N.snapshot_as_of(g, "start_time", 1_700_000_000))


@query("age_normalized", "SELECT group_id, line_no, round(age_days, 6) AS age_days, round(per_day, 6) AS per_day, round(log_per_day, 6) AS log_per_day FROM aged")
def _(spark, d):
    return A.aged(spark, d).select("group_id", "line_no", *(F.round(c, 6).alias(c) for c in ("age_days", "per_day", "log_per_day")))


BOUNDS, BUCKETS = [365, 1095, 1825], ["0-1y", "1-3y", "3-5y", "5y+"]
BUCKET_SQL = "CASE WHEN age_days <= 365 THEN '0-1y' WHEN age_days <= 1095 THEN '1-3y' WHEN age_days <= 1825 THEN '3-5y' ELSE '5y+' END"


@query("age_bucket", f"SELECT {BUCKET_SQL} AS age_bucket, count(*) AS n FROM aged GROUP BY 1")
def _(spark, d):
    return A.aged(spark, d).select(N.bucket(F.col("age_days"), BOUNDS, BUCKETS).alias("age_bucket")).groupBy("age_bucket").agg(F.count("*").alias("n"))


@query("default_fill_row", "SELECT group_id, line_no, item_code, coalesce(points, 500.0) AS points, 0 AS tag_count, 'unknown' AS phase FROM items")
def _(spark, d):
    from pyspark.sql import types as T

    template = T.StructType.fromDDL("group_id long, line_no int, item_code string, points double, tag_count int, phase string")
    return N.conform(A.items(spark, d).select("group_id", "line_no", "item_code", "points"), template, {"points": 500.0, "tag_count": 0, "phase": "unknown"})


GROUPS = {"index": ["index_letter", "index_number", "index_rank"], "solved": ["popularity", "log_popularity", "popularity_missing"], "points": ["points", "has_points"], "tags": ["tag_count", "tag__*"]}
SETS = {"index_only": ["index"], "solved_only": ["solved"], "all": ["index", "tags", "solved", "points"], "all_without_solved": ["index", "tags", "points"], "twice": ["index", "index"]}


@query("feature_sets", "SELECT s AS feature_set, count(*) * n AS \"values\", n AS n_columns FROM model, (VALUES ('index_only', 3), ('solved_only', 3), ('all', 9), ('all_without_solved', 6), ('twice', 3)) v(s, n) GROUP BY 1, 3")
def _(spark, d):
    rows = A.model_table(spark, d)
    out = None
    for name, cols in N.feature_sets(rows.columns, GROUPS, SETS).items():
        one = rows.select(*cols).agg((F.count("*") * len(cols)).alias("values")).select(F.lit(name).alias("feature_set"), "values", F.lit(len(cols)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("leakage_filter", "SELECT group_id, line_no, points, tag_count FROM model")
def _(spark, d):
    rows = A.model_table(spark, d).select("group_id", "line_no", "points", "tag_count", "popularity", "log_popularity", F.col("popularity").alias("Solved Popularity"))
    return N.drop_leaky(rows, ["popularity", "solved"])


@query("modelable_columns", "SELECT group_id, line_no, label FROM model")
def _(spark, d):
    return N.modelable(A.model_table(spark, d).select("group_id", "line_no", "label", "tags", F.struct("label").alias("s"), F.lit(b"x").alias("b")))


@query("filter_with_accounting", """SELECT 'rows_before' AS condition, count(*) AS removed FROM merged UNION ALL SELECT 'standard', count(*) FILTER (item_type <> 'STANDARD') FROM merged
UNION ALL SELECT 'labelled', count(*) FILTER (label IS NULL) FROM merged UNION ALL SELECT 'popular', count(*) FILTER (coalesce(popularity, 0) < 10) FROM merged
UNION ALL SELECT 'rows_after', count(*) FILTER (item_type = 'STANDARD' AND label IS NOT NULL AND popularity >= 10) FROM merged""")
def _(spark, d):
    return K.filter_report(A.merged(spark, d), {"standard": F.col("item_type") == "STANDARD", "labelled": F.col("label").isNotNull(), "popular": F.col("popularity") >= 10})[1]


@query("model_ready_filter", "SELECT group_id, line_no, label, popularity FROM merged WHERE item_type = 'STANDARD' AND label IS NOT NULL AND popularity IS NOT NULL AND start_time IS NOT NULL")
def _(spark, d):
    rows = K.fail_if(A.merged(spark, d), F.col("popularity") < 0, "negative popularity")
    ready = {"type": F.col("item_type") == "STANDARD", "label": F.col("label").isNotNull(), "popularity": F.col("popularity").isNotNull(), "keys": F.col("group_id").isNotNull() & F.col("line_no").isNotNull(), "group": F.col("start_time").isNotNull()}
    return K.filter_report(rows, ready)[0].select("group_id", "line_no", "label", "popularity")


@query("select_item", "SELECT group_id, line_no, item_code FROM items WHERE group_id = (SELECT min(group_id) FROM items) AND item_code LIKE 'B%' AND upper(item_code) = (SELECT min(upper(item_code)) FROM items WHERE item_code LIKE 'B%' AND group_id = (SELECT min(group_id) FROM items))")
def _(spark, d):
    rows = A.items(spark, d)
    first = rows.agg(F.min("group_id")).first()[0]
    code = rows.filter((F.col("group_id") == first) & F.col("item_code").startswith("B")).agg(F.min("item_code")).first()[0] or ""
    return K.select_item(rows, {"group_id": first}, "item_code", f" {code.lower()} ").select("group_id", "line_no", "item_code")


@query("non_finite_guard", "SELECT group_id, line_no FROM items WHERE label IS NULL OR points IS NULL")
def _(spark, d):
    return K.non_finite(A.items(spark, d).withColumn("points", F.when(F.col("points").isNull(), F.lit(float("nan"))).otherwise(F.col("points"))), ["label", "points"]).select("group_id", "line_no")


@query("strict_prepare", "SELECT group_id, line_no, CAST(label AS double) AS label, start_time FROM model")
def _(spark, d):
    return K.strict_prepare(A.model_table(spark, d), {"group_id": "long", "line_no": "int", "label": "double", "start_time": "long"}, A.KEYS, ["label", "start_time", *A.KEYS], "start_time")


@query("drop_null_keys", "SELECT group_id, line_no, points FROM items WHERE points IS NOT NULL")
def _(spark, d):
    return A.items(spark, d).select("group_id", "line_no", "points").dropna(subset=["points", "line_no"])
