"""URL filter: listed rules first, else rules that FP-growth mines from labelled URLs' token combinations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import written

# The listed rules, (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlFilterConfig:
    """Mined rules of either verdict need `support` of the labelled urls and `least` of them at the least, `confidence`, and `lift` over their
    verdict's base rate. What fewer urls than `least` have in common is chance, and its combinations are without end in long urls.
    `small_rules` bounds the rule table that is broadcast; a larger one is joined by shuffle, in `salts` parts a token."""

    rules: tuple[tuple[str, str], ...] = RULES
    support: float = 0.005
    confidence: float = 0.6
    lift: float = 1.2
    least: int = 5
    small_rules: int = 20_000
    salts: int = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda g: F.coalesce(F.regexp_extract(url, parts, g), F.lit(""))
    return F.translate(get(1), _UPPER, _LOWER), get(2)


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct lower-case tokens: scheme, host labels, path and query words; numbers are one token. Null has none."""
    words = F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}_-]+")
    words = F.transform(words, lambda w: F.when(w.rlike(r"^\d+$"), F.lit("0")).otherwise(w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def token_classes(urls: DataFrame, least: int) -> DataFrame:
    """(class, members, n): the tokens that occur in exactly the same n urls of (id, tokens), `least` at the least, named by the smallest. Two combined
    hashes of the urls' ids stand for the set. A class is no larger than one url's tokens."""
    seen = urls.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"))
    return seen.filter(F.col("n") >= least).groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.get("members", F.lit(0)).alias("class"), "members", "n")


def mine_rules(urls: DataFrame, cfg: UrlFilterConfig) -> DataFrame:
    """(antecedent, verdict, confidence, support) from labelled (id, tokens, bad) rows; the antecedent is an array of classes, each an array of
    tokens. FP-growth sees each url's classes and its label. A class stands for every choice of its tokens: as they always come together among
    labelled urls, all choices are rules of the same figures. So a rule fits a url that has one token of each class."""
    n = urls.count()
    classes = written(token_classes(urls, cfg.least), "classes")
    # tokens of fewer urls are in no rule
    named = classes.select("class", F.explode("members").alias("token"))
    have = urls.select("id", F.explode("tokens").alias("token")).join(named.hint("broadcast" if classes.count() <= cfg.small_rules else "merge"), "token").groupBy("id").agg(F.collect_set("class").alias("items"))
    label = F.when(F.col("bad"), F.lit("\tblock")).otherwise(F.lit("\tallow"))
    baskets = urls.join(have.hint("merge"), "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(cfg.support, min(1.0, (cfg.least - 0.5) / max(n, 1))), minConfidence=cfg.confidence).fit(written(baskets, "baskets"))
    verdict = F.col("consequent")[0]
    clean = F.forall("antecedent", lambda t: ~t.startswith("\t")) & verdict.startswith("\t")
    # a token that is common among all urls is no reason for either verdict, so both need the lift
    rules = model.associationRules.filter(clean & (F.col("lift") >= cfg.lift) & (F.round(F.col("support") * n) >= cfg.least))
    rules = rules.select(F.xxhash64("antecedent", "consequent").alias("rule"), F.explode("antecedent").alias("class"), F.substring(verdict, 2, 10).alias("verdict"), "confidence", "support")
    members = classes.select("class", "members").hint("broadcast" if classes.count() <= cfg.small_rules else "merge")
    return rules.join(members, "class").groupBy("rule", "verdict", "confidence", "support").agg(F.collect_list("members").alias("antecedent")).drop("rule")


def match_rules(urls: DataFrame, rules: DataFrame, cfg: UrlFilterConfig) -> DataFrame:
    """(url, mined) for the distinct (url, tokens) rows that a mined rule fits: the verdict of the most confident, then best
    supported, then last rule by the url's tokens in it. Each rule stands in the inverted index under the tokens of the class that fewest rules
    have."""
    small = rules.count() <= cfg.small_rules
    hint = "broadcast" if small else "merge"
    named = rules.withColumn("rule", F.to_json(F.struct("antecedent", "verdict")))
    flat = named.select("rule", F.explode("antecedent").alias("class"))
    spread = flat.groupBy("class").agg(F.count("*").alias("c"))
    rarest = flat.join(spread.hint(hint), "class").groupBy("rule").agg(F.min_by("class", F.struct("c", "class")).alias("class"))
    index = written(named.join(rarest.hint(hint), "rule").select("antecedent", "verdict", "confidence", "support", F.explode("class").alias("token")), "rules")
    tokens = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    if small:
        hits = tokens.join(index.hint("broadcast"), "token")
    else:
        # a token that a third of all urls have is dealt over several tasks, and so are its rules
        dealt = tokens.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(cfg.salts)).cast("int"))
        hits = dealt.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1)))).hint("merge"), ["token", "salt"])
    hits = hits.filter(F.forall("antecedent", lambda c: F.arrays_overlap(c, F.col("tokens"))))
    text = F.array_join(F.array_sort(F.transform("antecedent", lambda c: F.array_max(F.array_intersect(c, F.col("tokens"))))), " ")
    return hits.groupBy("url").agg(F.max_by("verdict", F.struct("confidence", "support", text)).alias("mined"))


def url_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", cfg: UrlFilterConfig = UrlFilterConfig()) -> DataFrame:
    """Judge every url, one row per row: (page_id, host, path, rule, verdict, mined).

    `labels` holds (doc_id, quality, toxic) for some pages; a page is bad if toxic is 1 or quality 0. The verdict is the
    longest listed rule's; without one the best mined rule's; without any, or with fewer than `least` labelled urls, allow. Null urls have an empty
    host and path and are allowed. Distinct urls are matched once, so repeated rows cost nothing and get equal rows. Very long urls are
    read whole. No pages give no rows. Other columns are not looked at.

    Urls are dealt by a hash to as many tasks as the session has shuffle partitions or cores before their tokens are multiplied out;
    what was found is written, so that the join back to the pages can split a url that many pages share.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.coalesce(bad, F.lit(False)).alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = rows.join(marks.hint("merge"), "page_id").select(F.monotonically_increasing_id().alias("id"), url_tokens(F.col("url")).alias("tokens"), "bad")
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism)
    distinct = rows.filter("url is not null").select("url").repartition(parts, "url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    known = written(known, "known")
    if known.isEmpty():
        judged = rows.withColumn("mined", F.lit(None).cast("string"))
    else:
        rules = written(mine_rules(known, cfg), "mined")
        found = written(match_rules(distinct, rules, cfg), "found")
        judged = rows.filter("url is not null").join(found.hint("merge"), "url", "left")
        judged = judged.unionByName(rows.filter("url is null").withColumn("mined", F.lit(None).cast("string")))
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), cfg.rules)
    judged = judged.withColumn("host", host).withColumn("path", path)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined"), F.lit("allow")).alias("verdict"), "mined")
