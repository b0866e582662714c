"""Documents to training tokens: language, near duplicates, personal data, mixture, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet in the shared folder
and reads them back for the next. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.llm.bpe import bpe_encode
from veridra.llm.common import fresh, put_back, set_aside, written
from veridra.llm.langid import UNKNOWN, with_language
from veridra.llm.mixing import MixConfig, mix
from veridra.llm.neardup import NearDupConfig, near_duplicates
from veridra.llm.pii import pseudonyms

#: A text whose best language has less than this mean probability is in no language that the network knows.
LEAST_SCORE = 0.4
#: Five words to a shingle, similarity 0.8 or more; 40 bands miss a pair at 0.8 once in ten million.
NEAR = NearDupConfig(k=5, percent=80, bands=40)
#: As many tokens as there are, spread evenly over domains, then languages, then sources; no text more than twice.
MIX = MixConfig(share=1.0, epochs=2)
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in a language, with `lang` filled in where it was null. Rejected: no letter (null and empty texts too), or no
    language stands out. Repeated rows are judged alike; an empty table, and one without any labelled text, leaves nothing."""
    made = ("held_out", "lang_pred", "score")
    rows, names = set_aside(docs, made)
    judged = with_language(rows)
    kept = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return put_back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), made, names).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Of rows with one id the one with the smallest text stays (null
    before all, ties by the other columns). Rows without an id take no part and stay, and texts without words are like no other. An
    empty table stays empty."""
    kept = near_duplicates(docs, cfg=NEAR).filter("kept").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", F.to_json(F.struct(*others)).alias("order"), F.struct(*others).alias("rest"))
    one = docs.join(kept.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(row["text"], row["order"])).alias("row"))
    first = one.select("doc_id", "row.text", *(F.col("row.rest")[c].alias(c) for c in others))
    return first.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, personal values replaced by pseudonyms; `n_chars` follows the text (null for null). Repeated rows change alike."""
    made = ("pii_found", "pii_kinds")
    rows, names = set_aside(docs, made)
    changed = pseudonyms(rows).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return put_back(changed, made, names).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as many times as the mixture takes it. Null and empty texts cost nothing and are taken as often as their leaf's epochs run;
    rows with one id are taken together. An empty table stays empty."""
    made = ("domain", "n_tokens", "leaf_budget", "copies")
    rows, names = set_aside(docs, made)
    taken = mix(rows, cfg=MIX).filter("copies > 0")
    # the generated column goes again at once
    copy = fresh("copy", taken.columns)
    taken = taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(copy)
    return put_back(taken, made, names).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, whole): token ids of each text, and whether they decode to it. Null text counts as empty and
    has no ids; repeated rows get equal ids; no rows give none."""
    coded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), RANKS, PATTERN, decoded=True)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("whole"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("PII", pii),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The first stage is a trained network, so no SQL gives these rows; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
