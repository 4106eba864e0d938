"""From raw documents to packed training windows, in five stages.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squigspark.llm import decontaminate, jaccard, langid, packing, queries, secrets
from squigspark.llm.common import fresh, shared_dir, table

#: Below this calibrated probability no language counts as identified: mixed and very short texts stay.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters, or no language stands out.

    The model learns from the very documents of this stage, and never sees the held-out fold's labels.
    """
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    scored = langid.with_language(docs, queries.langid_model(docs), pred=pred, score=score)
    return scored.filter((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id.

    Documents that have 0.8 or more of their five-word shingles in common (Jaccard) are linked.
    """
    return jaccard.deduplicate(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; findings are replaced by their kind in brackets, and n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document's tokens, with its window and offset."""
    return packing.pack(docs.select("doc_id", "text"), queries.packing_config())


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
