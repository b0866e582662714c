"""One query per text operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridra.llm.alignment import align_tokenizers
from veridra.llm.bpe import bpe_digest
from veridra.llm.chat import chat_digest
from veridra.llm.fingerprint import fingerprints
from veridra.llm.langid import identify
from veridra.llm.license_scan import license_scan
from veridra.llm.merkle import manifest_digest
from veridra.llm.mixing import mix
from veridra.llm.neardup import near_duplicates
from veridra.llm.pii import pseudonyms
from veridra.llm.token_counts import token_counts
from veridra.llm.topk import top_k
from veridra.llm.url_filter import url_filter

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECES, PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_fingerprints, op3_top_k, op4_token_counts, op5_url_filter, op6_mixing, op7_pii, op8_language_id, op9_byte_bpe, op10_near_duplicates,
        op11_chat_format, op12_merkle_manifest, op13_alignment,
    )
    return {f.__name__: f for f in found}


TOP_K_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS x FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_inner_product(q.x, c.x) AS bigint) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.n <> q.n)
SELECT query_id, CAST(rank AS int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY 1) m USING (doc_id)"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
w AS (  -- the marks' lengths, and one backslash for every mark inside a text; other roles are named in their marks
  SELECT *, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(?:SYS|INST|ROLE)\]|\[\\*/TURN\]')) END
    + length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:SYS|INST|ROLE)\]|\[\\*/TURN\]')) AS chars,
    row_number() OVER t AS place, lag(role) OVER t || '>' || role AS step
  FROM c WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
o AS (SELECT *, CASE WHEN place = 1 THEN role IN ('system', 'user') ELSE step IN ('system>user', 'user>assistant', 'assistant>user') END AS fits FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS bigint) AS formatted_chars,
  coalesce(min(place) FILTER (NOT fits), count(*) + 1) - 1 AS n_in_order
FROM o GROUP BY conv_id"""

MERKLE_SQL = """
WITH RECURSIVE v AS (
  SELECT doc_id, lang, source, n_chars, text, CASE WHEN 0 = xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(1, length(CAST(doc_id AS varchar)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS varchar), i, 1)) AS ubigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint))))) % 3
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claimed
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS varchar)) || ':' || n_chars, '-') AS head FROM v)),
ranked AS (
  SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
  SELECT g, 0 AS level, rank AS place, leaf AS h, n FROM ranked
  UNION ALL SELECT g, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY g, level, place // 8, n),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS rank, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, rank AS place, subroot AS h, n FROM subroots
  UNION ALL SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY level, place // 8, n),
steps AS (
  SELECT g, level, place, coalesce(string_agg(h, '') OVER l, '') AS a, coalesce(string_agg(h, '') OVER r, '') AS b
  FROM (SELECT g, level, place, h, n FROM low WHERE n > 1 UNION ALL SELECT NULL, level, place, h, n FROM high WHERE n > 1)
  WINDOW l AS (PARTITION BY g, level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY g, level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
powers AS (SELECT k AS level, CAST(pow(8, k) AS bigint) AS p FROM range(20) t(k)),
paths AS (
  SELECT d.doc_id, d.leaf, d.claimed, s.subroot, list(struct_pack(h := '', a := x.a, b := x.b) ORDER BY x.g IS NULL, x.level) FILTER (x.level IS NOT NULL) AS path
  FROM ranked d JOIN subroots s USING (g) LEFT JOIN (SELECT * FROM steps JOIN powers USING (level)) x
    ON (x.g = d.g AND x.place = d.rank // x.p) OR (x.g IS NULL AND x.place = s.rank // x.p)
  GROUP BY d.g, d.rank, d.doc_id, d.leaf, d.claimed, s.subroot),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(list_aggregate(list_prepend('', list_transform(coalesce(path, []), lambda s: s.a || s.b)), 'string_agg', '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(h := claimed, a := '', b := ''), coalesce(path, [])), lambda x, s: struct_pack(h := sha256(s.a || x.h || s.b), a := '', b := '')).h AS folded_root FROM paths)
SELECT *, folded_root = root AS verified FROM done"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries whose whole result SQL gives; the others are tested against plain Python."""
    return {"op3_top_k": TOP_K_SQL, "op10_near_duplicates": NEAR_SQL, "op11_chat_format": CHAT_SQL, "op12_merkle_manifest": MERKLE_SQL}
