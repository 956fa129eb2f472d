"""From raw documents to token ids: rules, near copies, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.llm import decontam, near_copies, pii, quality, spm
from metricwatch.llm.common import by_ids, stored, table
from metricwatch.session import prepare


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In order of the ids, documents whose five-word shingles are not 0.8 similar to those of one kept before."""
    return by_ids(docs, stored(near_copies.copies_to_drop(docs)), "left_anti")


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; `n_chars` follows the new text where it is there."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, ids, n_ids, returns`: token ids, and whether decoding gives the text back."""
    return spm.encode_checked(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", good_documents),
    ("near copies", one_of_each_group),
    ("benchmark leaks", unleaked),
    ("personal data", private),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again as the next one's input."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# The last stages have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None
