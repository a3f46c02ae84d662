"""Token counts by heap-and-linked-list byte-pair merging.

A text falls into words; in each, the adjacent pair of lowest rank merges until
none is left. The count is the number of bytes less the number of merges: no
token identifiers are made. Counts of words are kept by each worker.

Defined results: a null text has null counts, an empty text has zero; repeated
rows repeat; a word of any length takes O(n log n) steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.bpe import CACHE_WORDS, VOCABULARY, vocabulary
from inkstrata.llm.textvec import map_text, table

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


class Counter(dict):
    """word -> number of tokens, filled as words turn up."""

    def __init__(self, path: str):
        self.count = vocabulary(path).count

    def __missing__(self, word: str) -> int:
        n = self[word] = self.count(word.encode())
        return n


_COUNTERS: dict[str, Counter] = {}


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> list[int | None]:
    cache = _COUNTERS.setdefault(path, Counter(path))
    words = vocabulary(path).words
    out = []
    for t in texts:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out.append(None if t is None else sum(map(cache.__getitem__, words(t))))
    return out


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, bytes and tokens of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(1)
        return pa.record_batch([batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(count_tokens(text.to_pylist(), path), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(rows, ["doc_id", "text"], "text", run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
