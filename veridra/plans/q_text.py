"""Queries over pages and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veridra.functions import text as X
from veridra.operators import metrics as M
from veridra.operators import select as S
from veridra.operators.encode import encoded, fit_encoding
from veridra.operators.ranks import quantiles_by
from veridra.operators.sparse_ridge import predict_sparse, sparse_ridge
from veridra.plans.base import query
from veridra.sources import adapters as A
from veridra.sources import files as FS
from veridra.sources.workspace import stored


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_steps(value: str, steps) -> str:
    return reduce(lambda v, s: f"regexp_replace({v}, {lit(s[0])}, {lit(s[1])}, 'g')", steps, value)


def sql_entities(value: str, table) -> str:
    return reduce(lambda v, s: f"replace({v}, {lit(s[0])}, {lit(s[1])})", table, value)


LINES_SQL = sql_steps(sql_entities(sql_steps("html", X.LINES), X.ENTITIES), X.TIDY)
FLAT_SQL = f"trim(regexp_replace({sql_entities(sql_entities(sql_steps('html', X.FLAT), X.ENTITIES), X.MATHS)}, '[ \\t\\r\\n]+', ' ', 'g'))"
FRAGMENT_SQL = "CASE WHEN regexp_matches(html, '(?i)<article[ >]') THEN regexp_extract(html, '(?is)<article[ >].*$', 0) ELSE html END"


@query("strip_html_lines", f"SELECT page_id, md5({LINES_SQL}) AS digest, length({LINES_SQL}) AS n FROM pages")
def _(spark, d):
    rows = A.pages(spark, d).select("page_id", X.strip_html(F.col("html"), True).alias("t"))
    return rows.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("strip_html_flat", f"SELECT page_id, md5({FLAT_SQL}) AS digest, length({FLAT_SQL}) AS n FROM pages")
def _(spark, d):
    rows = A.pages(spark, d).select("page_id", X.strip_html(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("extract_fragment", f"SELECT page_id, md5({FRAGMENT_SQL}) AS digest FROM pages")
def _(spark, d):
    return A.pages(spark, d).select("page_id", F.md5(X.fragment(F.col("html"), "article")).alias("digest"))


# Entities as an HTML parser reads them: those that HTML has always had end with their name, a semicolon or not; newer ones need it.
PARSED = tuple((k if k in ("&le;", "&ge;") else f"{k}?", v) for k, v in X.ENTITIES)
TITLE_SQL = f"trim(regexp_replace({sql_steps('''regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)''', (('<[^>]*>', ''), *PARSED))}, '[ \\t\\r\\n]+', ' ', 'g'))"


ARTICLE_SQL = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
BODY_SQL = f"trim(regexp_replace({sql_steps(f'regexp_replace({ARTICLE_SQL}, {lit(chr(40) + '?is)^.*</h1>')}, {lit('')})', (('<[^>]*>', ' '), *PARSED))}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query("extract_sections", f"SELECT page_id, {TITLE_SQL} AS title, md5({BODY_SQL}) AS body, '' AS items, '' AS rest, len(regexp_extract_all({ARTICLE_SQL}, '(?i)<p[ >]')) AS paragraphs FROM pages")
def _(spark, d):
    return X.extract_sections(A.pages(spark, d), "page_id", "html", X.ARTICLE).select("page_id", "title", F.md5("body").alias("body"), "items", F.col("text").alias("rest"), "paragraphs")


@query("extract_text_fields", f"SELECT page_id, {TITLE_SQL} AS title, md5(trim({TITLE_SQL} || ' ' || {BODY_SQL})) AS combined FROM pages")
def _(spark, d):
    rows = X.combined_text(X.extract_sections(A.pages(spark, d), "page_id", "html", X.ARTICLE), ["title", "body", "items", "text"])
    return rows.select("page_id", "title", F.md5("combined_text").alias("combined"))


@query("drop_section_title", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'Inputs ' || text END AS text FROM benchmark")
def _(spark, d):
    title = F.when(F.col("item_id") % 2 == 0, "INPUT: ").otherwise("Inputs ")
    return A.table(spark, d, "benchmark").select("item_id", X.drop_title(F.concat(title, "text"), "Input").alias("text"))


@query("sample_counts", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS samples, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 3 END AS blocks FROM pages")
def _(spark, d):
    marks = F.when(F.col("page_id") % 3 == 0, '<div class="sample-test"></div><div class="sample-tests">').otherwise('<div class="input"></div><div class="input"></div><div class="output">')
    samples, blocks = X.sample_counts(F.concat("html", marks))
    return A.pages(spark, d).select("page_id", samples.alias("samples"), blocks.alias("blocks"))


@query("parse_time_limit", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(round_even(p_retailprice * 1000, 0) AS bigint) WHEN 1 THEN CAST(round_even(p_retailprice, 0) AS bigint) WHEN 2 THEN 1000 * p_size END AS ms FROM part")
def _(spark, d):
    kind, price, size = F.col("p_size") % 4, F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.col("p_size").cast("string")
    text = F.when(kind == 0, F.concat(price, F.lit(" Seconds"))).when(kind == 1, F.concat(price, F.lit("ms per test"))).when(kind == 2, F.concat(F.lit("7 tests of "), size, F.lit(" sec"))).otherwise(F.concat(size, F.lit(" sections")))
    return A.table(spark, d, "part").select("p_partkey", X.parse_quantity(text, X.TIME_UNITS).alias("ms"))


SIZES = (" kilobytes", " MB", " gigabyte", " stones", " KiB", "mib", " GiB", " mbx")


@query("parse_memory_limit", "SELECT p_partkey, CASE WHEN p_size % 8 IN (0, 4) THEN CAST(ceil(p_partkey / 1024) AS bigint) WHEN p_size % 8 IN (1, 5) THEN p_partkey WHEN p_size % 8 IN (2, 6) THEN 1024 * p_partkey END AS mb FROM part")
def _(spark, d):
    unit = F.element_at(F.array(*map(F.lit, SIZES)), F.col("p_size") % 8 + 1)
    return A.table(spark, d, "part").select("p_partkey", X.parse_memory(F.concat(F.col("p_partkey").cast("string"), unit)).alias("mb"))


# What the documents end in, so that every flag and counter, and what comes near them, occurs.
MARKS = (
    "", " of vertices", " Trees!", " rooted_tree", " (lists)", " substring", " DP", " dynamic programming", " dynamic  programming", " Points", " greedily", " greedy", "graph", " expected value", " query the judge",
    " queries", " permutations", " bitwise", " Dijkstra's", " shortest path", " flush.", " x + y <= 3.5 ≠ 2", " -7 +2.25 1.2.3", " O(n log n) O (1)O(2) ZO(3)", " AB Q z_9 ABc É", " $a$ \\alpha \\( \\]",
    " f(x) g (y) 9h(z) a[i] _k[2] == != :: -> f(g(h))", "\r\nlast\x0bline\u2028", " at most SUM, sums limit Integers sum sum", " it's well-known --x-- '", "\n\n", " ٣٤ ½ x²",
)
MARKED_SQL = f"(SELECT doc_id, coalesce(text, '') || [{', '.join(map(lit, MARKS))}][doc_id % {len(MARKS)} + 1] AS t FROM documents)"
W = "\\p{L}\\p{N}_"


def marked(spark, d):
    return A.docs(spark, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % len(MARKS) + 1).cast("int"))).alias("t"))


def sql_words(t: str, pattern: str) -> str:
    """A pattern for whole words: all else is doubled, so that each word has signs of its own around it."""
    return f"regexp_replace({t}, '([^{W}])', '\\1\\1', 'g'), '(?:^|[^{W}])(?:{pattern.replace(' ', '  ')})(?:$|[^{W}])'"


def sql_flags(t: str) -> dict[str, str]:
    return {k: f"CAST(regexp_matches({sql_words(f'lower({t})', p)}) AS int)" for k, p in X.KEYWORDS.items()}


def sql_counters(t: str, paragraphs: str) -> dict[str, str]:
    """The counters by other means than lookaround, which DuckDB has not."""
    every = lambda p, x=t: f"regexp_extract_all({x}, {lit(p)})"
    some = lambda values, test: f"len(list_filter({values}, lambda x: {test}))"
    numbers, runs, lines = every("[-+]?\\p{Nd}+(?:\\.\\p{Nd}+)?"), every(f"[{W}]+"), f"string_split_regex({t}, {lit(chr(13) + chr(10) + '|[' + X.BREAKS + ']')})"
    return {
        "n_chars": f"length({t})",
        "n_words": some(every(f"[{W}'-]+"), f"regexp_matches(x, '[{W}]')"),
        "n_lines": f"len({lines}) - CAST({lines}[-1] = '' AS int)",
        "n_paragraphs": paragraphs,
        "n_numbers": f"len({numbers})",
        "n_floats": some(numbers, "contains(x, '.')"),
        "n_integers": some(numbers, "NOT contains(x, '.')"),
        "n_inequalities": f"len({every('<=|>=|<|>|≤|≥')})",
        "n_maths": f"len({every('[-+*/=^%≤≥]|<=|>=')})",
        "n_constraint_words": f"len(regexp_extract_all({sql_words(f'lower({t})', 'constraints?|limits?|integers?|positive|negative|at most|at least|sum')}))",
        "n_big_o": f"len(regexp_extract_all(replace({t}, ')', '))'), '(?:^|[^{W}])O[\\s\\x0b\\p{{Z}}]*\\([^)]*\\)'))",
        "n_uppercase": some(runs, "regexp_full_match(x, '[A-Z]{2,}')"),
        "n_one_letter": some(runs, "regexp_full_match(x, '[A-Za-z]')"),
        "n_latex": f"len({every('[$][^$]+[$]|' + chr(92) * 2 + '(?:[A-Za-z]+|[()]|' + chr(92) + '[|' + chr(92) + '])')})",
        "n_code": some(every(f"[{W}]+[\\s\\x0b\\p{{Z}}]*\\(|[{W}]+\\[[^\\]]*\\]|==|!=|<=|>=|::|->"), "NOT ends_with(x, '(') OR regexp_matches(x, '^[A-Za-z_]')"),
    }


def sql_columns(made: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in made.items())


@query("keyword_flags", f"SELECT doc_id, {sql_columns(sql_flags('t'))} FROM {MARKED_SQL}")
def _(spark, d):
    return marked(spark, d).select("doc_id", *(v.alias(k) for k, v in X.keyword_flags(F.col("t")).items()))


@query("text_counters", f"SELECT doc_id, {sql_columns(sql_counters('t', 'doc_id % 5'))} FROM {MARKED_SQL}")
def _(spark, d):
    return marked(spark, d).select("doc_id", *(v.alias(k) for k, v in X.text_counters(F.col("t"), F.col("doc_id") % 5).items()))


LENGTHS_SQL = {"title": TITLE_SQL, "body": BODY_SQL, "items": "''", "text": "''"}


@query("section_lengths", f"SELECT page_id, {', '.join(f'length({v}) AS {s}_length, CAST(length({v}) > 0 AS int) AS has_{s}' for s, v in LENGTHS_SQL.items())} FROM pages")
def _(spark, d):
    """Every section of the page, and the text that is in none."""
    rows = X.extract_sections(A.pages(spark, d), "page_id", "html", X.ARTICLE)
    return rows.select("page_id", *(v.alias(k) for k, v in X.section_lengths(list(LENGTHS_SQL)).items()))


STATUS_SQL = "CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'empty' WHEN page_id % 5 = 2 THEN 'pdf' WHEN page_id % 5 = 3 THEN 'failed' ELSE 'parsed' END"


def statuses(spark, d):
    """Pages of which some are missing, empty, of another kind or without text, with status, size, digest and body."""
    k = F.col("page_id") % 5
    page = F.when(k == 1, "").when(k == 2, F.concat(F.lit("%PDF-"), "html")).when(k == 3, "<html></html>").when(k == 4, F.col("html"))
    rows = A.pages(spark, d).withColumn("html", page)
    kind = FS.classify_content(F.col("html").cast("binary"), F.lit("x.html"))
    body = X.strip_html(F.col("html"))
    return rows.select("page_id", "html", X.page_status(F.col("html"), kind, body).alias("status"), F.octet_length("html").alias("size_bytes"), F.sha2(F.col("html"), 256).alias("sha256"), body.alias("body"))


@query("parse_status", f"SELECT page_id, {STATUS_SQL} AS status, CASE page_id % 5 WHEN 1 THEN 0 WHEN 2 THEN strlen(html) + 5 WHEN 3 THEN 13 WHEN 4 THEN strlen(html) END AS size_bytes FROM pages")
def _(spark, d):
    return statuses(spark, d).select("page_id", "status", "size_bytes")


@query("source_manifest", "SELECT page_id, CASE page_id % 5 WHEN 1 THEN sha256('') WHEN 2 THEN sha256('%PDF-' || html) WHEN 3 THEN sha256('<html></html>') WHEN 4 THEN sha256(html) END AS sha256 FROM pages")
def _(spark, d):
    return statuses(spark, d).select("page_id", "sha256")


@query("empty_feature_defaults", f"SELECT page_id, CASE WHEN page_id % 5 = 4 THEN length({FLAT_SQL}) ELSE 0 END AS n_chars, CASE WHEN page_id % 5 = 4 THEN 7 END AS time_limit FROM pages")
def _(spark, d):
    rows = statuses(spark, d).withColumn("n_chars", F.length("body").cast("long")).withColumn("time_limit", F.lit(7))
    return X.with_defaults(rows, "status", ["n_chars", "time_limit"], ("time_limit",)).select("page_id", "n_chars", "time_limit")


def statement_features(rows):
    """All counters, flags and limits of (page_id, html, status, body) rows, defaults where a page was not parsed."""
    page = F.coalesce("html", F.lit(""))
    counters = X.text_counters(F.col("body"), F.regexp_count(page, F.lit(r"(?i)<p[\s>]")))
    flags = {f"kw_{k}": v for k, v in X.keyword_flags(F.col("body")).items()}
    samples, blocks = X.sample_counts(page)
    limit = lambda name: F.regexp_extract("body", rf"(?i){name} limit[^0-9]{{0,40}}([0-9.]+ ?[a-z]+)", 1)
    limits = {"time_limit_ms": X.parse_quantity(limit("time"), X.TIME_UNITS), "memory_limit_mb": X.parse_memory(limit("memory"))}
    made = counters | flags | {"samples": samples, "blocks": blocks} | limits
    return X.with_defaults(rows.select("page_id", "status", *(v.alias(k) for k, v in made.items())), "status", list(made), tuple(limits))


FEATURES_SQL = sql_counters("t", "len(regexp_extract_all(html, '(?i)<p[ >]'))") | {f"kw_{k}": v for k, v in sql_flags("t").items()}


@query("feature_row_assembly", f"SELECT status, count(*) AS n, {', '.join(f'sum(CASE WHEN page_id % 5 = 4 THEN {v} ELSE 0 END) AS {k}' for k, v in FEATURES_SQL.items())} FROM (SELECT page_id, html, {STATUS_SQL} AS status, {FLAT_SQL} AS t FROM pages) GROUP BY 1")
def _(spark, d):
    rows = statement_features(statuses(spark, d))
    return rows.groupBy("status").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in FEATURES_SQL))


#: between items of a printed page's text, and what separates them in an extracted section
SPACE_SQL = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"


def statement_pages(spark, d):
    """Documents as pages in the statement layout: a header with title and limits, the text as body, input, output, an example and for two in three a note."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = lambda name, *parts: F.concat(F.lit(f'<div class="{name}">'), *(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("</div>"))
    titled = lambda name, title, *parts: block(name, f'<div class="section-title">{title}</div><p>', *parts, "</p>")
    key, source = F.col("doc_id").cast("string"), F.coalesce("source", F.lit("none"))
    time = block("time-limit", '<div class="property-title">time limit per test</div>', (F.col("doc_id") % 5 + 1).cast("string"), ".5 seconds")
    memory = block("memory-limit", "memory limit per test<br>", (F.col("doc_id") % 7 * 64).cast("string"), " megabytes")
    example = block("sample-test", block("input", "<pre>", key, "</pre>"), block("output", "<pre>", F.coalesce(F.col("n_chars").cast("string"), F.lit("")), "</pre>"))
    note = F.when(F.col("doc_id") % 3 != 0, titled("note", "Note", "About &laquo;", source, "&raquo;.")).otherwise("")
    body = F.concat(F.lit("<div><p>"), text, F.lit("</p><p>End.</p></div>"))
    header = block("header", block("title", key, ". ", source), time, memory, block("header-rest", "standard input"))
    page = F.concat(F.lit("<html><body><div>menu<p>skipped</p></div>"), block("problem-statement", header, body, titled("input-specification", "Input", "Read ", source), titled("output-specification", "Output", "Print <b>", key, "</b>"), example, note), F.lit("<div>footer</div></body></html>"))
    return A.table(spark, d, "documents").select("doc_id", page.alias("html"))


@query("statement_sections", f"""WITH r AS (SELECT doc_id, doc_id || '. ' || coalesce(source, 'none') AS title, doc_id % 5 * 1000 + 1500 AS time_limit_ms, doc_id % 7 * 64 AS memory_limit_mb, trim(regexp_replace(coalesce(text, '') || ' End.', '{SPACE_SQL}', ' ', 'g')) AS body,
    'Read ' || coalesce(source, 'none') AS input, 'Print ' || doc_id AS output, doc_id || coalesce(' ' || n_chars, '') AS examples, CASE WHEN doc_id % 3 <> 0 THEN 'About «' || coalesce(source, 'none') || '».' ELSE '' END AS note FROM documents)
  SELECT doc_id, title, time_limit_ms, memory_limit_mb, md5(body) AS body, input, output, examples, note, CAST(doc_id % 3 <> 0 AS int) AS has_note, length(note) AS note_length, 1 AS samples, CASE WHEN doc_id % 3 <> 0 THEN 5 ELSE 4 END AS paragraphs FROM r""")
def _(spark, d):
    """The statement layout read back: limits as numbers, every section, and what is not in one."""
    keyed = statement_pages(spark, d).select(F.struct("doc_id", X.sample_counts(F.col("html"))[0].alias("samples")).alias("k"), "html")
    rows = X.extract_sections(keyed, "k", "html", X.STATEMENT).select("k.*", "*")
    limits = {"time_limit_ms": X.parse_quantity(F.col("time_limit"), X.TIME_UNITS), "memory_limit_mb": X.parse_memory(F.col("memory_limit"))}
    return rows.select("doc_id", "title", *(v.alias(k) for k, v in limits.items()), F.md5("text").alias("body"), "input", "output", "examples", "note", *(v.alias(k) for k, v in X.section_lengths(["note"]).items()), "samples", "paragraphs")


@query("text_record_assembly", f"SELECT o_orderkey AS item, coalesce(page_id % 5 = 4, false) AS available, coalesce(CASE WHEN page_id % 5 = 4 THEN n ELSE 0 END, 0) AS n FROM orders LEFT JOIN (SELECT page_id, length({FLAT_SQL}) AS n FROM pages) ON o_orderkey = page_id")
def _(spark, d):
    items = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"))
    texts = statuses(spark, d).select(F.col("page_id").alias("item"), F.when(F.col("status") == "parsed", F.col("body")).alias("text"))
    return X.fill_text(items.join(texts, "item", "left"), "text", "available").select("item", "available", F.length("text").alias("n"))


@query("text_fill", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(text) END AS n, doc_id % 3 <> 0 AS text_available FROM documents")
def _(spark, d):
    rows = A.docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    return X.fill_text(rows, "text").select("doc_id", F.length("text").alias("n"), "text_available")


@query("utc_format", "SELECT group_id, strftime(to_timestamp(start_time) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS utc FROM groups_")
def _(spark, d):
    return A.groups(spark, d).select("group_id", X.iso_utc(F.col("start_time")).alias("utc"))


CLAMP = "least(greatest(round_even(({x}) / 100, 0) * 100, 800.0::double), 90000.0::double)"


@query("value_range", f"SELECT group_id, line_no, {CLAMP.format(x='label')} AS value, {CLAMP.format(x='label - greatest(coalesce(points, 250.0), 50.0)')} AS low, {CLAMP.format(x='label + greatest(coalesce(points, 250.0), 50.0)')} AS high FROM items WHERE label IS NOT NULL")
def _(spark, d):
    value, low, high = S.prediction_range(F.col("label"), F.coalesce("points", F.lit(250.0)), high=90_000)
    return A.items(spark, d).filter("label is not null").select(*A.KEYS, value.alias("value"), low.alias("low"), high.alias("high"))


@query("statement_coverage", f"SELECT count(*) FILTER (page_id % 5 <> 0) AS cached, count(*) FILTER (page_id % 5 = 4) AS parsed, round(count(*) FILTER (page_id % 5 = 4) / count(*), 6) AS rate, round(avg(CASE WHEN page_id % 5 = 4 THEN length({FLAT_SQL}) END), 4) AS mean_length, max(CASE WHEN page_id % 5 = 4 THEN length({FLAT_SQL}) END) AS max_length, median(CASE WHEN page_id % 5 = 4 THEN length({FLAT_SQL}) END) AS median_length FROM pages")
def _(spark, d):
    rows = stored(statuses(spark, d).select("status", F.when(F.col("status") == "parsed", F.length("body")).alias("n")))
    parsed = F.count_if(F.col("status") == "parsed")
    median = quantiles_by(rows, [], "n", {"median": 0.5}).first()
    numbers = rows.agg(F.count_if(F.col("status") != "missing").alias("cached"), parsed.alias("parsed"), F.round(parsed / F.count("*"), 6).alias("rate"), F.round(F.avg("n"), 4).alias("mean_length"), F.max("n").alias("max_length"))
    return numbers.withColumn("median_length", F.lit(median and median.median))


WORDS_SQL = f"regexp_extract_all(translate(lower(text), {lit(X._ACCENTED)}, {lit(X._PLAIN)}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
TFIDF_SQL = f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
  g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 < 7),
  v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c WHERE doc_id % 10 < 7 GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.85::double * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 20000),
  x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n.n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), n)
  SELECT doc_id, count(*) AS n_terms, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight, min(term) AS first_term FROM x GROUP BY 1"""


def weights(spark, d, of=None):
    return X.tfidf(A.docs(spark, d), "doc_id", "text", F.col("doc_id") % 10 < 7, of=of)


@query("tfidf", TFIDF_SQL)
def _(spark, d):
    return weights(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.min("term").alias("first_term"))


LIGHT = ("n_chars", "n_words", "n_lines", "n_numbers")
#: what each setting's model sees: the document's kind, its counters, its terms
SETTINGS = {
    "metadata": ("metadata",),
    "text_light": ("text_light",),
    "tfidf": ("tfidf",),
    "metadata_text_light": ("metadata", "text_light"),
    "metadata_tfidf": ("metadata", "tfidf"),
    "text_light_tfidf": ("text_light", "tfidf"),
    "metadata_text_light_tfidf": ("metadata", "text_light", "tfidf"),
}


def study_rows(spark, d):
    """(labelled documents with `part`, their kind, counters and the places and weights of their terms, stored; the number of terms). Seven in ten are
    train rows."""
    # the vocabulary comes from all train rows, weights are needed for labelled ones
    long = stored(weights(spark, d, F.col("label").isNotNull()))
    names = [r.term for r in long.select("term").distinct().orderBy("term").collect()]  # max_terms at most
    index = F.broadcast(spark.createDataFrame(list(enumerate(names)), "i int, term string"))
    # max_terms entries a document at most
    found = long.join(index, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("entries"))
    entries = F.coalesce("entries", F.array().cast("array<struct<i: int, weight: double>>"))
    counters = X.text_counters(F.col("text"))
    docs = A.docs(spark, d).filter("label is not null").select("doc_id", "lang", "source", F.col("label").cast("double").alias("label"), *(counters[c].alias(c) for c in LIGHT))
    rows = docs.join(found.hint("merge"), "doc_id", "left").withColumn("part", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test"))
    rows = rows.withColumns({"terms": F.transform(entries, lambda e: e["i"]), "weights": F.transform(entries, lambda e: e["weight"])}).drop("entries")
    return stored(rows), len(names)


@query("tfidf_ridge")
def _(spark, d):
    """Ridge models of documents' quality in seven settings, scored on the documents that took no part as well."""
    rows, n_terms = study_rows(spark, d)
    e = fit_encoding(rows.filter("part = 'train'"), [*LIGHT, "lang", "source"])
    rows = encoded(rows, e)
    shifted = F.transform("terms", lambda i: i + e.size)
    rows = stored(rows.select("doc_id", "part", "label", F.concat("indices", shifted).alias("indices"), F.concat("values", "weights").alias("values")))
    blocks = {"metadata": [e.ranges[c] for c in ("lang", "source")], "text_light": [e.ranges[c] for c in LIGHT], "tfidf": [(e.size, e.size + n_terms)]}
    sets = {s: [r for p in parts for r in blocks[p]] for s, parts in SETTINGS.items()}
    # the counters come first and grow together
    models = sparse_ridge(rows.filter("part = 'train'"), e.size + n_terms, "label", sets, 1.0, head=len(LIGHT))
    scored = predict_sparse(rows, models, ["part", "label"])
    return M.regression_metrics(scored, "label", "predicted", ["setting", "part"], (0.25, 0.5))


@query("round_to_100", "SELECT group_id, line_no, round_even(label / 100, 0) * 100 AS nearest FROM items WHERE label IS NOT NULL")
def _(spark, d):
    return A.items(spark, d).filter("label is not null").select(*A.KEYS, (F.bround(F.col("label") / 100) * 100).alias("nearest"))
