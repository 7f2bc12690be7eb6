"""One query for each operator, with production parameters, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import byte_bpe, digests
from .common import table
from .embedding_dedup import embedding_components
from .line_dedup import line_dedup
from .packing import pack
from .quality_knn import quality_votes
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .sharding import kd_shards
from .simhash import simhash_components
from .token_counts import token_counts
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_LIMITS = {r.metric: r for r in RULES}
ORACLE_SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}], lower(x)))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN {_LIMITS["mean_word_length"].least} AND {_LIMITS["mean_word_length"].most}
       AND n_symbols / n_words <= {_LIMITS["symbol_ratio"].most}
       AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= {_LIMITS["dup_line_ratio"].most}
       AND (n_words < {_LIMITS["stop_word_ratio"].from_words} OR n_stop_words / n_words >= {_LIMITS["stop_word_ratio"].least}) AS kept,
       n_lines, n_stop_words
FROM f
"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        finish=digests,
        schema="n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_words=50, counts=("n_lines", "n_deleted_lines"))


#: Windows of whole lines with 50 words that need their last or their first line; those with an earlier equal are deleted.
LINE_DEDUP_SQL = r"""
lines AS (
  SELECT doc_id, i, ls[i] AS line, len(list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs}))),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines),
spans AS (
  SELECT a.doc_id, a.i AS s, b.i AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND a.i <= b.i
  WHERE b.upto - a.upto + a.words >= 50 AND (b.upto - b.words - a.upto + a.words < 50 OR b.upto - a.upto < 50)),
windows AS (
  SELECT spans.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS t
  FROM spans JOIN lines ON lines.doc_id = spans.doc_id AND i BETWEEN s AND e GROUP BY ALL),
later AS (SELECT doc_id, s, e FROM windows QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT lines.doc_id, i FROM lines JOIN later ON lines.doc_id = later.doc_id AND i BETWEEN s AND e)
"""
ORACLE_SQL["op10_line_dedup"] = (
    "WITH "
    + LINE_DEDUP_SQL.replace("{docs}", "documents")
    + """
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text,
       count(*) AS n_lines, count(g.i) AS n_deleted_lines
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
)


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


@query
def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op5_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM component
"""
