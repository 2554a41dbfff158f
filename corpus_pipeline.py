"""A training corpus from ``documents``: quality classifier, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives a DataFrame that is written as
Parquet and read back as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import byte_bpe, decontaminate, jaccard_join, quality_classifier, secret_scan
from riskweave.llm.common import discard, fresh, materialize, table

#: A document whose quality score is below this goes.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the labelled documents of its own input.

    Null and empty texts have the score of the intercept alone; without labels every score is one half, and all stay.
    Repeated rows are scored each by itself; rows without an id are not learnt from.
    """
    weights = quality_classifier.train(spark, docs, table(spark, sf_dir, "labels"))
    name = fresh("score", docs)
    scored = quality_classifier.score(docs, weights, out_col=name)
    return scored.filter(F.col(name) >= LEAST_QUALITY).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.deduplicate(spark, docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item's question and answer stand. Rows go by id (null included) and text, so of rows
    that share an id only those that leak go; null and empty texts stay."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    leaked = decontaminate.leaks(spark, named, table(spark, sf_dir, "benchmark"))
    return jaccard_join.drop_rows(spark, docs, leaked, "doc_id", "text")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text. A null or empty text has no ids; repeated rows and
    those without an id each have their own."""
    done = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    exact = F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", token_stage),
]
#: SQL cannot express the classifier's fit, the links' closure or the merges; the stages are held against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``: every stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, before)  # of the tables between the stages only the last is kept
    return docs
