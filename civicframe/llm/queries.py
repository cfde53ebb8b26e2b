"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe, ef_trie_lm, ftrl_quality, gru_toxicity, html_blocks, line_crf, norm_topk, phrase_index, qgram_decontam, repair_ids,
    simhash_gray, spectrum_whiten, warc_derive,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_qgram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_decontam.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.apply(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gru_toxicity.apply(docs, gru_toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.apply(table(spark, sf_dir, "documents"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, with_ids=False)


@query
def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ftrl_quality.apply(docs, ftrl_quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.apply(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_ef_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef_trie_lm.apply(table(spark, sf_dir, "documents"))


@query
def op9_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_derive.responses(table(spark, sf_dir, "pages"))
    return warc_derive.apply(records)


@query
def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.apply(table(spark, sf_dir, "pages"))


@query
def op11_spectrum_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum_whiten.apply(table(spark, sf_dir, "embeddings"))


@query
def op12_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.search(table(spark, sf_dir, "embeddings"))


ORACLES["op12_norm_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op13_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_index"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), spans AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4)) AS length(k) WHERE i + k - 1 <= len(w)
), grams AS (
  SELECT lang, k, phrase, count(*) AS f FROM spans GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), frequent AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 30
), parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a
  FROM frequent, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS spot(i, m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), covered AS (
  SELECT f.lang, f.phrase FROM frequent f JOIN parts p ON p.lang = f.lang AND p.phrase = f.phrase WHERE 100 * p.a >= 80 * f.a
), cut_up AS (
  SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM frequent
), named AS (
  SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM cut_up
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((2000000 * c.a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM named c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covered USING (lang, phrase) WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
