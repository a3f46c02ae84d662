"""Models, OCR and parsers behind adapters that are built once in each worker.

An adapter is a callable that takes a list of texts (or byte strings) and
returns as many strings; a failure of one item is an error in its row and fails
nothing else. Results of calls that cost or vary are to be written to a table
before they are used twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIES, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 30.0


def call(rows: DataFrame, build: Callable[[], Callable[[list], list[str]]], column: str, retries: int = RETRIES, wait: float = FIRST_WAIT) -> DataFrame:
    """``rows`` (doc_id, instance, ``column``) with the adapter's output or the error."""
    schema = "doc_id bigint, instance int, output string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter = build()
        for batch in batches:
            outputs, errors = [], []
            for scalar in batch[column]:  # only one item at a time is a Python object, the batch stays in Arrow
                item, value, error = scalar.as_py(), None, None
                for k in range(retries):
                    try:
                        value, error = adapter([item])[0], None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a model is a row's error
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < retries:
                            time.sleep(min(wait * 2**k, LONGEST_WAIT))
                outputs.append(value), errors.append(error)
            yield pa.record_batch([batch["doc_id"], batch["instance"], pa.array(outputs, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "instance", "output", "error"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("instance").cast("int").alias("instance"), column).mapInArrow(run, schema)


def instances(docs: DataFrame, n: int) -> DataFrame:
    """Each document ``n`` times, numbered from 1."""
    return docs.withColumn("instance", F.explode(F.sequence(F.lit(1), F.lit(n))))


def candidates(docs: DataFrame, build: Callable, n: int, column: str = "text") -> DataFrame:
    """doc_id and the JSON answers of the instances that succeeded."""
    answers = call(instances(docs, n), build, column)
    return answers.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("instance", "output")))), lambda x: x["output"]).alias("outputs"), F.count("error").alias("failed"))


def decide_workflow(answers: DataFrame, registered: list[str], threshold: float = 0.5) -> DataFrame:
    """doc_id, workflow and why there is none. ``answers``: doc_id, name, confidence, error."""
    known = F.col("name").isin(*registered)
    sure = F.col("confidence") >= threshold
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error"))).when(~F.coalesce(known, F.lit(False)), "not registered").when(~F.coalesce(sure, F.lit(False)), "little confidence")
    return answers.select("doc_id", F.when(reason.isNull(), F.col("name")).alias("workflow"), reason.alias("reason"))


def split_sections(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections with their pages that exist, and those asked for that do not. ``answers``: doc_id and a JSON object of lists of pages."""
    asked = answers.select("doc_id", F.explode_outer(F.from_json("output", "map<string, array<int>>")).alias("section", "asked"))
    have = pages.groupBy("doc_id").agg(F.collect_set("page").alias("have"))
    none = F.array().cast("array<int>")
    rows = asked.join(have, "doc_id", "left").select("doc_id", "section", F.coalesce("asked", none).alias("asked"), F.coalesce(F.col("have").cast("array<int>"), none).alias("have"))
    return rows.where("section is not null").select("doc_id", "section", F.array_sort(F.array_intersect("asked", "have")).alias("pages"), F.array_except("asked", "have").alias("warned"))
