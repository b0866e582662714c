"""Column functions over HTML and text: stripping, fragments, counters, flags, limits, statuses, tf-idf."""

from __future__ import annotations

import html
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.sources.workspace import TASK_TEXT, tasks

# What separates lines, and the entities that are decoded without a parser; the ampersand comes last.
BLOCKS = "p|div|li|h1|h2|h3|h4|h5|h6|tr|pre|ul|ol|table|article|nav|section|header|footer"
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&le;", "≤"), ("&ge;", "≥"), ("&amp;", "&"))
#: (pattern, replacement) in order; they mean the same in Java and RE2
DROP = (("(?is)<script[^>]*>.*?</script[^>]*>", " "), ("(?is)<style[^>]*>.*?</style[^>]*>", " "), ("(?s)<!--.*?-->", " "))
LINES = (*DROP, (f"(?i)</(?:{BLOCKS})[ ]*>|<br[ ]*/?>", "\n"), ("<[^>]*>", ""))
TIDY = (("[ \t\r]+", " "), ("(?m)^ | $", ""), ("\n+", "\n"), ("^\n|\n$", ""))
FLAT = (*DROP, ("<[^>]*>", " "))
MATHS = (("≤", "<="), ("≥", ">="), ("≠", "!="), ("×", "*"), ("−", "-"))

# Topic flags by the words that raise them.
KEYWORDS = {
    "graph": "graphs?|vertices|edges",
    "tree": "trees?|rooted",
    "array": "arrays?|sequences?|lists?",
    "string": "strings?|substrings?|characters?",
    "dp": "dp|dynamic programming",
    "geometry": "geometry|points?|polygons?|circles?",
    "greedy": "greedy",
    "probability": "probability|expected value|random",
    "interactive": "interactive|flush|query the judge",
    "permutation": "permutations?",
    "binary": "binary|bits?|bitwise",
    "shortest_path": "shortest paths?|dijkstra|floyd",
    "query": "query|queries",
}


def replaced(col: Column, steps) -> Column:
    for pattern, new in steps:
        col = F.regexp_replace(col, pattern, new)
    return col


def unescaped(col: Column, table=ENTITIES) -> Column:
    for old, new in table:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def strip_html(col: Column, keep_lines: bool = False) -> Column:
    """Text of a page: scripts, styles, comments and tags go, entities are decoded. Lines end where blocks do, or all is one line with
    maths signs in ASCII. Null is empty."""
    text = F.coalesce(col, F.lit(""))
    if keep_lines:
        return replaced(unescaped(replaced(text, LINES)), TIDY)
    flat = unescaped(unescaped(replaced(text, FLAT)), MATHS)
    return F.trim(F.regexp_replace(flat, r"[ \t\r\n]+", " "))


def fragment(col: Column, root: str) -> Column:
    """From the first element that `root` (a tag, or .class) names to the end; the whole page if there is none."""
    head = rf'<[a-zA-Z][^>]*class="[^"]*\b{root[1:]}\b[^"]*"' if root.startswith(".") else f"<{root}[ >]"
    cut = F.regexp_extract(col, f"(?is){head}.*$", 0)
    return F.when(cut == "", col).otherwise(cut)


def drop_title(col: Column, title: str) -> Column:
    return F.regexp_replace(F.ltrim(col), rf"^(?i:{title})(?:[:.]\s*|\s+|$)", "")


@dataclass(frozen=True)
class Profile:
    """Which elements hold which section: tag or .class -> name; `root` bounds the page's body; `skip` is left out."""

    root: str
    sections: Mapping[str, str]
    skip: tuple[str, ...] = ()


ARTICLE = Profile("article", {"h1": "title", "p": "body", "li": "items"}, ("nav", "footer", ".ad"))
STATEMENT = Profile(".problem-statement", {".title": "title", ".time-limit": "time_limit", ".memory-limit": "memory_limit", ".input-specification": "input", ".output-specification": "output", ".note": "note", ".sample-test": "examples", ".sample-tests": "examples"}, (".section-title", ".header-rest"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Sections(HTMLParser):
    """Text inside the root by nearest enclosing section; an end tag that was left out ends with its parent."""

    def __init__(self, profile: Profile):
        super().__init__(convert_charrefs=True)
        self.profile, self.stack, self.parts, self.inside, self.paragraphs = profile, [], {}, False, 0
        self.root_at = 0

    def _named(self, names, tag: str, classes: list[str]) -> str | None:
        return next((n for n in names if n == tag or n[:1] == "." and n[1:] in classes), None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if not self.inside and tag not in _VOID and self._named((self.profile.root,), tag, classes):
            self.inside, self.root_at = True, len(self.stack)
        above = self.stack[-1][1] if self.stack else ("text" if self.inside else None)
        own = self._named(self.profile.sections, tag, classes)
        self.paragraphs += self.inside and tag == "p"
        hidden = tag in ("script", "style") or self._named(self.profile.skip, tag, classes) or above == ""
        if tag not in _VOID:
            self.stack.append((tag, "" if hidden else self.profile.sections[own] if own else above if above is not None else ("text" if self.inside else None)))
        self.parts.setdefault(self.stack[-1][1] if self.stack else None, []).append(" ")

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]
            self.inside = self.inside and len(self.stack) > self.root_at
        if self.stack:
            self.parts.setdefault(self.stack[-1][1], []).append(" ")

    def handle_data(self, data: str) -> None:
        name = self.stack[-1][1] if self.stack else ("text" if self.inside else None)
        if name and self.inside:
            self.parts.setdefault(name, []).append(data)


def extract_sections(pages: DataFrame, key: str, page: str, profile: Profile) -> DataFrame:
    """(key, a column per section, text, paragraphs): each section's text on one line, `text` that of the rest, and the number of the
    body's paragraphs. Null pages have empty sections."""
    names = list(dict.fromkeys([*profile.sections.values(), "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                parser = _Sections(profile)
                parser.feed(value or "")
                parser.close()
                rows.append([*(" ".join("".join(parser.parts.get(n, ())).split()) for n in names), parser.paragraphs])
            kinds = [pa.string()] * len(names) + [pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names, "paragraphs"])

    schema = T.StructType([pages.schema[key], *(T.StructField(n, T.StringType()) for n in names), T.StructField("paragraphs", T.LongType())])
    return pages.select(key, page).mapInArrow(run, schema)


def combined_text(df: DataFrame, sections: list[str]) -> DataFrame:
    """Add combined_text: the non-empty sections, a blank between."""
    return df.withColumn("combined_text", F.array_join(F.filter(F.array(*(F.trim(F.coalesce(F.col(s), F.lit(""))) for s in sections)), lambda x: x != ""), " "))


def sample_counts(col: Column) -> tuple[Column, Column]:
    """(samples, blocks): sample blocks, else the smaller of input and output blocks; and all input and output blocks."""
    count = lambda name: F.regexp_count(col, F.lit(rf'(?i)<div[^>]*class="{name}"'))
    samples, inputs, outputs = count("sample-tests?"), count("input"), count("output")
    return F.when(samples > 0, samples).otherwise(F.least(inputs, outputs)), inputs + outputs


def parse_quantity(col: Column, units: Mapping[str, float], mode: str = "round") -> Column:
    """The first number that stands before one of the units, in the base unit, rounded half to even (or up with `ceil`); null if there is none."""
    pattern = rf"(\d+(?:\.\d+)?)\s*({'|'.join(units)}){END}"
    low = F.lower(col)
    number, unit = F.regexp_extract(low, pattern, 1).try_cast("double"), F.regexp_extract(low, pattern, 2)
    scaled = F.lit(None).cast("double")
    for names, factor in units.items():
        scaled = F.when(unit.rlike(f"^(?:{names})$"), number * factor).otherwise(scaled)
    return (F.ceil(scaled) if mode == "ceil" else F.bround(scaled)).cast("long")


# Units in the order in which they are tried.
TIME_UNITS = {"milliseconds?|msecs?|ms": 1.0, "seconds?|secs?|s": 1000.0}
MEMORY_UNITS = {"megabytes?|mb|mib": 1.0, "gigabytes?|gb|gib": 1024.0, "kilobytes?|kb|kib": 1 / 1024}


def parse_memory(col: Column) -> Column:
    """Megabytes of the first size: kilobytes are rounded up, gigabytes are 1024."""
    small = F.regexp_extract(F.lower(col), rf"\d+(?:\.\d+)?\s*({'|'.join(MEMORY_UNITS)}){END}", 1).startswith("k")
    return F.when(small, parse_quantity(col, MEMORY_UNITS, "ceil")).otherwise(parse_quantity(col, MEMORY_UNITS))


#: letters, digits and the underscore of any script, and the places where a word of them begins and ends
WORD = r"[\p{L}\p{N}_]"
BEGIN, END = rf"(?<!{WORD})", rf"(?!{WORD})"


def keyword_flags(col: Column, keywords: Mapping[str, str] = KEYWORDS) -> dict[str, Column]:
    """A 0/1 flag per topic, whole words in any case."""
    return {k: col.rlike(rf"(?iu){BEGIN}(?:{p}){END}").cast("int") for k, p in keywords.items()}


# Counter -> pattern.
COUNTERS = {
    "numbers": r"[-+]?\p{Nd}+(?:\.\p{Nd}+)?",
    "floats": r"[-+]?(?<!\p{Nd})\p{Nd}++\.\p{Nd}+",
    "inequalities": r"<=|>=|<|>|≤|≥",
    "maths": r"[+\-*/=%^]|<=|>=|≤|≥",
    "constraint_words": rf"(?iu){BEGIN}(?:constraints?|limits?|integers?|positive|negative|at most|at least|sum){END}",
    "big_o": rf"{BEGIN}O[\s\x0b\p{{Z}}]*\([^)]*\)",
    "uppercase": rf"{BEGIN}[A-Z]{{2,}}{END}",
    "one_letter": rf"{BEGIN}[A-Za-z]{END}",
    "latex": r"\\[A-Za-z]+|\\[()\[\]]|\$[^$]+\$",
    "code": rf"{BEGIN}[A-Za-z_]{WORD}*[\s\x0b\p{{Z}}]*\(|{BEGIN}{WORD}+\[[^\]]*\]|==|!=|<=|>=|::|->",
}
# What ends a line.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def text_counters(col: Column, paragraphs: Column | None = None) -> dict[str, Column]:
    """Lengths and counts of a text; null counts as empty. Numbers take their sign along; integers are the numbers without a fraction;
    words may hold apostrophes and hyphens. Paragraphs are the page's, 0 where none are given."""
    t = F.coalesce(col, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    lines = count(f"\r\n|[{BREAKS}]") + F.when(t == "", 0).otherwise((F.instr(F.lit(BREAKS), F.substring(t, -1, 1)) == 0).cast("int"))
    out = {"n_chars": F.length(t), "n_words": count(rf"{WORD}[\p{{L}}\p{{N}}_'-]*+"), "n_lines": lines, "n_paragraphs": F.coalesce(paragraphs, F.lit(0)) if paragraphs is not None else F.lit(0)}
    out |= {f"n_{k}": count(p) for k, p in COUNTERS.items()}
    return {k: v.cast("long") for k, v in (out | {"n_integers": out["n_numbers"] - out["n_floats"]}).items()}


def section_lengths(sections: list[str]) -> dict[str, Column]:
    out = {}
    for s in sections:
        n = F.length(F.coalesce(F.col(s), F.lit(""))).cast("long")
        out |= {f"{s}_length": n, f"has_{s}": (n > 0).cast("int")}
    return out


def with_defaults(df: DataFrame, status: str, features: list[str], nullable: tuple[str, ...] = ()) -> DataFrame:
    """Rows that were not parsed keep 0 in every feature, null in the nullable ones."""
    return df.withColumns({c: F.when(F.col(status) == "parsed", F.col(c)).otherwise(F.lit(None if c in nullable else 0)) for c in features})


def page_status(page: Column, kind: Column, body: Column) -> Column:
    """missing, empty, pdf, parsed or failed."""
    return F.when(page.isNull(), "missing").when(kind == "empty", "empty").when(kind == "pdf", "pdf").when(F.trim(F.coalesce(body, F.lit(""))) != "", "parsed").otherwise("failed")


def fill_text(df: DataFrame, col: str, available: str = "text_available") -> DataFrame:
    """Null text to empty; availability is derived where it is absent or null."""
    text = F.coalesce(F.col(col), F.lit(""))
    derived = F.trim(text) != ""
    have = F.coalesce(F.col(available), derived) if available in df.columns else derived
    return df.withColumn(available, have).withColumn(col, text)


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@dataclass(frozen=True)
class TfidfConfig:
    min_df: int = 3
    max_share: float = 0.85
    max_terms: int = 20_000


# Letters that lose their accents.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def words(col: Column) -> Column:
    """Words of two or more letters and digits, lower case without accents."""
    plain = F.translate(F.lower(F.coalesce(col, F.lit(""))), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(words: Column) -> Column:
    """The words and their pairs. Give it a column that holds the words: it is read more than once."""
    return F.concat(words, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def _codes(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words; the words' numbers among them, the place of each word's row, and whether the next word is of the same row)."""
    coded = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, row[1:] == row[:-1]


def vocabulary(texts: DataFrame, words: str, n: int, cfg: TfidfConfig) -> DataFrame:
    """(term, idf), max_terms rows at most: the vocabulary of `tfidf` from the `n` train rows' words. Words and pairs are counted as numbers per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, word, row, same = _codes(batch.column(0))
            size = len(known)
            # a word's number, or that of a pair behind those of all words
            code = np.concatenate([word, size + word[:-1][same] * size + word[1:][same]])
            terms, at, total = np.unique(code, return_inverse=True, return_counts=True)
            once = np.unique(np.concatenate([row, row[:-1][same]]) * len(terms) + at)
            df = np.bincount(once % max(len(terms), 1), minlength=len(terms))
            one = int(np.searchsorted(terms, size))
            first, second = np.divmod(terms[one:] - size, max(size, 1))
            pairs = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), " ")
            text = pa.concat_arrays([known.take(pa.array(terms[:one])), pairs])
            yield pa.RecordBatch.from_arrays([text, pa.array(df.astype(np.int64)), pa.array(total.astype(np.int64))], names=["term", "df", "total"])

    counts = texts.select(words).mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    kept = counts.filter((F.col("df") >= cfg.min_df) & (F.col("df") <= cfg.max_share * n)).orderBy(F.desc("total"), "term").limit(cfg.max_terms)
    return kept.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, key: str, col: str, train: Column, cfg: TfidfConfig = TfidfConfig(), of: Column | None = None) -> DataFrame:
    """(key, term, weight) in long form: (1 + ln tf) * idf, unit length per document, of all documents or those that `of` names. Terms, their document frequencies and
    the vocabulary (by total count, then term) come from all train rows only; idf = ln((1 + n) / (1 + df)) + 1.

    The vocabulary is counted where the texts lie: each batch's terms are summed before anything is shuffled. Then whole texts are dealt by key, and only terms
    of the vocabulary are counted per document. A task gets some MB of text, however many there are, as it holds a row for each of their terms."""
    parts = tasks(df.sparkSession, df.agg(F.sum(F.octet_length(col))).first()[0] or 0, TASK_TEXT)
    known = df.filter(train)
    terms = vocabulary(known.select(F.col(col)).repartition(parts).select(words(F.col(col)).alias("_words")), "_words", known.count(), cfg)
    texts = (df if of is None else df.filter(of)).select(key, F.col(col).alias("_text")).repartition(parts, F.col(key)).select(key, words(F.col("_text")).alias("_words"))
    # at most max_terms rows
    found = texts.select(key, F.explode(ngrams(F.col("_words"))).alias("term")).join(F.broadcast(terms), "term")
    counts = found.groupBy(key, "term", "idf").agg(F.count("*").alias("tf")).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return counts.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


def unescape_all(text: str) -> str:
    """Every named and numbered entity; for use inside Arrow jobs."""
    return html.unescape(text)
