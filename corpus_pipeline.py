"""Language ID, exact dedup, near dedup, secret redaction and packing, one after another over the documents.

Each stage works on all that the one before it kept, is written as Parquet in the shared folder, and is read
again. All but the last give the columns of ``documents``; the last gives the pieces of texts by bin.

In every stage an empty table gives no rows, and further columns, whatever their names, pass through or (in packing) are not read;
ids may be null or repeat, as rows are judged, not ids. Of what comes in, only language ID sees null texts and texts without letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.exact import exact_dedup
from orrery.llm.language import rejecting
from orrery.llm.packing import best_fit
from orrery.llm.scratch import written
from orrery.llm.secrets import redact
from orrery.llm.simhash import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without letters or without a likely language go.

    Null and empty texts go; if no row has a label, all go. Repeated rows are judged alike."""
    return rejecting(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those with equal texts: the largest doc_id.

    A null text equals an empty one. Of rows that repeat text and id, one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): the smallest doc_id.

    Null ids come last, and of rows that repeat the least id one stays. Texts without words are copies of one another."""
    return near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by their kind, and n_chars to match.

    Null texts stay null. Repeated rows are redacted alike; spans that touch or overlap become one."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document's tokens into training sequences.

    Null and empty texts are one separator each; repeated rows are pieces of their own."""
    return best_fit(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", packing)]

#: The learned classifier and the trie search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
