"""Plain search of many phrases in many texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.operators.locate import around

#: Phrases that one automaton holds; more are sought in several passes over the texts, each with a part of them.
PHRASES = 20_000
HIT_SCHEMA = "item_id bigint, doc_id bigint, place int, context string"


def first_hits(docs: DataFrame, phrases: DataFrame, context: int = 20, most: int = PHRASES) -> DataFrame:
    """(item_id, doc_id, place, context): the first place, from 1, of each phrase (item_id, phrase) in each text (doc_id, text), any case, with what surrounds it.

    A phrase is any run of characters, wherever it lies in a word; blank ones are found nowhere. All phrases of a pass are sought at
    once while a text is read, and no text is moved. The parts of a longer list are by a hash of the id, so results do not depend on ``most``.
    """
    asked = phrases.select(F.col("item_id").cast("bigint").alias("item_id"), "phrase").where("phrase is not null and phrase <> ''")
    passes = max(1, -(-asked.count() // most))
    out = None
    for k in range(passes):
        part: dict[str, list[int]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toLocalIterator():
            part.setdefault(r["phrase"].lower(), []).append(r["item_id"])
        one = docs.select("doc_id", "text").mapInArrow(_seeker(part, context), HIT_SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def _seeker(part: dict[str, list[int]], context: int):
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not held and part:
            a = ahocorasick.Automaton()
            for p in part:
                a.add_word(p, p)
            a.make_automaton()
            held.append(a)
        for batch in batches:
            items, ids, places, contexts = [], [], [], []
            for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                first: dict[str, int] = {}
                for end, p in held[0].iter((text or "").lower()) if held else ():
                    first.setdefault(p, end + 1 - len(p))
                for p, at in first.items():
                    for item in part[p]:
                        items.append(item), ids.append(doc), places.append(at + 1), contexts.append(around(text, at, len(p), context))
            yield pa.record_batch([pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(contexts, pa.string())], names=["item_id", "doc_id", "place", "context"])

    return run
