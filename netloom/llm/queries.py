"""The registered queries of the text operators, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import edit_fingerprint, embed_dedup, langid, mixing, packing, pii, simhash, token_count, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, bits=2).select("doc_id", "fingerprint", "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.col("n_copies").cast("long").alias("n_copies"), F.col("copy").cast("long").alias("copy"), "shuffle_key")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_embedding_dedup, op3_url_filter, op4_pii, op5_simhash, op6_token_counts, op7_edit_fingerprint, op8_mixing, op9_packing, op10_language_id)
}

_U = f"CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0"

#: Poisson counts from the same hash, by the cumulative distribution as running sums of its terms.
ORACLES: dict[str, str] = {
    "op8_mixing": f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS s, CAST(greatest(coalesce(sum(length(text)), 1), 1) AS DOUBLE) AS size FROM documents GROUP BY 1
), totals AS (
  SELECT sum(size) AS n, sum(pow(size, {mixing.ALPHA})) AS w FROM sizes
), rates AS (
  SELECT s, pow(size, {mixing.ALPHA}) / w * ({mixing.BUDGET} * n) / size AS rate FROM sizes, totals
), terms AS (
  SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, (SELECT unnest(generate_series(0, 200)) AS k)
), cdf AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms
), counted AS (
  SELECT d.doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(d.source, '') AND cdf.c <= {_U}) AS n_copies FROM documents d
)
SELECT doc_id, source, n_copies, copy, md5('{mixing.SEED}#' || coalesce(CAST(doc_id AS VARCHAR), '') || '#' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT doc_id, source, CAST(n_copies AS BIGINT) AS n_copies, unnest(generate_series(1, n_copies)) AS copy FROM counted)
""",
}
