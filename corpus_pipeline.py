"""The corpus pipeline: documents -> clean, distinct, uncontaminated, redacted and encoded text.

Defined results of all stages: rows with a null ``doc_id`` or text, and empty
texts, are never rejected, copies or leaks and pass through; rows equal in
``doc_id`` and text become one in ``near_duplicates``, and of differing texts of
one ``doc_id`` each is judged by itself; extra columns pass through all stages
but the last; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm.bpe_codec import encode_stage
from inkstrata.llm.decontamination import drop_leaks
from inkstrata.llm.pii import redact
from inkstrata.llm.simhash_dedup import keep_one
from inkstrata.llm.textvec import drop_folder, ensure_checkpoint, table
from inkstrata.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; without labels of both classes none does."""
    return drop_toxic(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the least ``doc_id``, then the least text hash."""
    return keep_one(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; an empty benchmark leaves all."""
    return drop_leaks(spark, docs, sf_dir)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets; ``n_chars`` follows the text."""
    return redact(spark, docs, sf_dir)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, whether they decode to the text, language and source; a null text has null tokens."""
    return encode_stage(spark, docs, sf_dir)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]

#: Trained fields, graphs and byte-pair merging are beyond SQL; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the checkpoint folder that the next stage reads.

    A stage's table is deleted once the next one's is written; the last one stays for the reader.
    """
    ensure_checkpoint(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if read:
            drop_folder(spark, read)
        read = f"{base}/{name}"
    return docs
