"""One query per operator over its whole table, and the SQL it is compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetlens.llm.bpe_table import encode_decode, encoded_digest
from onsetlens.llm.common import table
from onsetlens.llm.filter_audit import filter_audit
from onsetlens.llm.fingerprint import fingerprint_documents
from onsetlens.llm.language_id import language_id
from onsetlens.llm.license_scan import license_digest, scan_licenses
from onsetlens.llm.line_dedup import fuzzy_line_dedup
from onsetlens.llm.mix import mix
from onsetlens.llm.near_dup import near_duplicates
from onsetlens.llm.periodic import run_digest
from onsetlens.llm.simhash import simhash_groups
from onsetlens.llm.token_count import token_counts
from onsetlens.llm.token_file import token_file
from onsetlens.llm.topk import top_k

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op2_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_line_dedup(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op10_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digest(encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE))


def op11_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_minhash_bayes": op2_minhash_bayes,
    "op3_paragraph_sketch": op3_paragraph_sketch,
    "op4_mix_sources": op4_mix_sources,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_token_file": op8_token_file,
    "op9_license_scan": op9_license_scan,
    "op10_bpe_table": op10_bpe_table,
    "op11_simhash_golay": op11_simhash_golay,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

# Training, tokenizers, hash families and synchronising sets have no SQL.
ORACLES: dict[str, str] = {
    "op13_filter_audit": r"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda w: w <> '') AS words
      FROM documents
    ),
    failing AS (
      SELECT doc_id, part,
             len(words) < 100 AS a,
             100 * len(list_distinct(words)) < 80 * len(words) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
      FROM texts
    ),
    marked AS (
      SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
             coalesce(good, false) AS good, coalesce(bad, false) AS bad
      FROM failing LEFT JOIN (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) USING (doc_id)
    ),
    cells AS (
      SELECT part, mask, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS toxic
      FROM marked GROUP BY part, mask
    ),
    letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    walk AS (
      SELECT '' AS prefix, '' AS last, 0 AS step, 0 AS before, 0 AS own
      UNION ALL
      SELECT prefix || letter, letter, step + 1, before | own, bit
      FROM walk JOIN letters ON (before | own) & bit = 0
    ),
    metrics AS (
      SELECT part, prefix, last, step,
             sum(docs) FILTER (WHERE mask & (before | own) = 0) AS kept,
             sum(docs) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS removed,
             sum(docs) FILTER (WHERE mask & own <> 0 AND mask & before <> 0) AS redundant,
             sum(docs) FILTER (WHERE mask = own) AS unique_fails,
             sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS good_lost,
             sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS toxic_lost
      FROM walk, cells WHERE step > 0 GROUP BY part, prefix, last, step
    ),
    every AS (
      SELECT m.*, o.prefix AS filter_order
      FROM metrics m JOIN (SELECT prefix FROM walk WHERE step = 5) o ON m.prefix = left(o.prefix, m.step)
    )
    SELECT part, filter_order, CAST(step AS INT) AS step,
           CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
           CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, last) AS BIGINT) AS shapley
    FROM every""",
}
