"""Byte-pair encoding by speculation and verification, and decoding.

The new words of a slice of texts are cut by greedy longest match, all at once.
All their adjacent token pairs are then tested: a sequence is the byte-pair
encoding of its bytes exactly if every adjacent pair is what merging the two
tokens' bytes gives. Only words with a failing pair undergo exact merging, which
also takes them all at once.

Defined results: a null text has null tokens, an empty text no tokens; any
valid UTF-8 text decodes to itself; repeated rows repeat.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.bpe import CACHE_WORDS, VOCABULARY, Vocabulary, ranges, vocabulary
from inkstrata.llm.textvec import map_text, table, utf8_parts

SCHEMA = "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean"


class _Numbers(dict):
    """word -> its number; words met for the first time also queue in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.failed = self.seen = 0
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        words = [w.encode() for w in self.numbers.new]
        self.numbers.new = []
        flat, size = self.vocab.greedy_all(words)
        word = np.repeat(np.arange(len(words)), size)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(flat[inner] * self.vocab.size + flat[inner + 1], return_inverse=True)
        good = self.vocab.compatible(pair // self.vocab.size, pair % self.vocab.size)
        bad = np.unique(word[inner[~good[back]]])
        self.seen += len(words)
        self.failed += len(bad)
        start = np.cumsum(size) - size
        if len(bad):
            exact, size[bad] = self.vocab.merge_all([words[k] for k in bad.tolist()])
            start[bad] = len(flat) + np.cumsum(size[bad]) - size[bad]
            flat = np.concatenate([flat, exact])[ranges(start, size)]
            start = np.cumsum(size) - size
        first = len(self.numbers) - len(words)
        while len(self.start) < len(self.numbers):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first : len(self.numbers)] = self.used + start
        self.size[first : len(self.numbers)] = size
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another, and the offsets of each text."""
        if len(self.numbers) > CACHE_WORDS:
            self._reset()
        words = [self.vocab.words(t) for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
        if self.numbers.new:
            self._learn()
        size = self.size[number]
        tokens = self.flat[ranges(self.start[number], size)]
        cum = np.concatenate([[0], np.cumsum(size)])
        return tokens, cum[np.concatenate([[0], np.cumsum(counts)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary(path))
    return _ENCODERS[path]


def decode_rows(vocab: Vocabulary, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the byte offsets of each row."""
    data, ends = vocab.decode(tokens)
    return data, np.concatenate([[0], ends])[off]


def encode(docs: DataFrame, path: str = VOCABULARY, carried: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of every document, and whether decoding them gives the text again; columns ``carried`` along come last."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        null = np.asarray(batch.column(1).is_null())
        text = batch.column(1).fill_null("")
        tokens, off = enc.encode(text.to_pylist())
        data, at = decode_rows(enc.vocab, tokens, off)
        want, raw = utf8_parts(text)
        same = (np.diff(at) == np.diff(want)).astype(bool)
        if same.all():
            wrong = np.flatnonzero(data != raw)
            same[np.searchsorted(want, wrong, side="right") - 1] = False
        else:
            same = np.array([a == b for a, b in zip((bytes(data[s:e]) for s, e in zip(at, at[1:])), (bytes(raw[s:e]) for s, e in zip(want, want[1:])))])
        offsets = pa.array(off.astype(np.int32), mask=np.append(null, False))
        out = [batch.column(0), pa.array(np.diff(off).astype(np.int32), mask=null), pa.ListArray.from_arrays(offsets, pa.array(tokens)), pa.array(same, mask=null)]
        return pa.record_batch([*out, *batch.columns[2:]], names=["doc_id", "n_tokens", "tokens", "round_trip", *carried])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    schema = SCHEMA + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return map_text(rows, rows.columns, "text", run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with (doc_id, tokens); null tokens give a null text."""

    def run(batches):
        for batch in batches:
            vocab = vocabulary(path)
            lists = batch.column(1)
            null = np.asarray(lists.is_null())
            size = np.where(null, 0, np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
            tokens = np.asarray(lists.flatten()).astype(np.int64)
            data, at = decode_rows(vocab, tokens, np.concatenate([[0], np.cumsum(size)]))
            raw = bytes(data)
            yield pa.record_batch([batch.column(0), pa.array([None if x else raw[s:e].decode("utf-8", "replace") for x, s, e in zip(null, at, at[1:])], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")


def op5_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: tokens of every document, with its language and source; repeated ids repeat."""
    return encode(docs, carried=tuple(c for c in ("lang", "source") if c in docs.columns))
