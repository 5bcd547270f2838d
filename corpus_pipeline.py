"""A training-data pipeline of five stages: toxicity, SimHash near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import mixing, packing, pii, simhash, toxicity
from netloom.llm.common import Scope, Table, small_side


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document the classifier rejects go (all rows of that doc_id); rows with a null doc_id stay."""
    scores = toxicity.toxicity_scores(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = Table(scores.where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "toxic").df
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies stays: that of the smallest doc_id."""
    return simhash.simhash_dedup(docs, words=5, bits=2)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced by their kind; n_chars follows the new text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in a global random order."""
    return mixing.mixed(docs).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learned scores, fingerprints and tokenizers are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again. What a stage wrote for itself goes when it is done, and what it
    returned when the next one is done; the last one's rows stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with Scope() as scope:
            now = Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            docs = scope.keep(now)
        if before is not None:
            before.drop()
        before = now
    return docs
