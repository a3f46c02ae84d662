"""Document fingerprints by order min-hashing (Marcais et al. 2019).

The k-mers of a text (``K`` characters) are numbered by occurrence, so that a
k-mer's second appearance is another element than its first. For each of
``ROWS`` hash functions the ``TUPLE`` least elements are taken, put back into
text order and hashed as a tuple. Two texts agree in a row only if they share
these elements in the same order, which makes agreement sensitive to edit
distance where plain min-hashing sees only the set.

Defined results: a null text has a null signature, an empty one an empty
signature; a text of fewer than ``K`` characters is one k-mer; with fewer than
``TUPLE`` k-mers the tuple holds them all; repeated rows repeat; equal elements
cannot occur, since (k-mer, occurrence) is unique in a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.textvec import U64, Words, list_array, map_text, mix, signed, table

K = 8
TUPLE = 3
ROWS = 16
_SEEDS = mix(np.arange(1, ROWS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
_ODD = mix(_SEEDS + U64(1)) | U64(1)
#: Elements hashed at once, so that the table of all hash functions stays in cache.
_BLOCK = 1 << 12
SCHEMA = "doc_id bigint, n_kmers int, signature array<bigint>, fingerprint bigint"


def row_hash(element: np.ndarray, row: int | slice) -> np.ndarray:
    """The hash functions of ``row`` over elements, one line for each."""
    x = (element[None, :] ^ _SEEDS[row, None]) * _ODD[row, None]
    return x ^ (x >> U64(32))


def kmers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers in text order, and the offsets of each row."""
    w = Words(text, lower=False)
    lead = np.flatnonzero((w.buf & 0xC0) != 0x80)
    off = np.searchsorted(lead, w.text_off)
    size = np.diff(off)
    room = np.where(size > 0, np.maximum(size - K + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(room)])
    at = np.repeat(off[:-1] - out[:-1], room) + np.arange(out[-1])
    edge = np.append(lead, len(w.buf))
    stop = np.minimum(at + K, np.repeat(off[1:], room))
    return w.span_hash(edge[at], edge[stop]), out


def occurrences(kmer: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often the k-mer has come before in its row."""
    row = np.repeat(np.arange(len(off) - 1, dtype=U64), np.diff(off))
    key = mix(kmer + row * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    by = key[order]
    first = np.concatenate([[True], by[1:] != by[:-1]]) if len(by) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0)) if len(by) else np.zeros(0, np.int64)
    out = np.empty(len(by), dtype=U64)
    out[order] = (np.arange(len(by)) - start).astype(U64)
    return out


def least(element: np.ndarray) -> np.ndarray:
    """Positions of the TUPLE least elements under each hash function, in text order."""
    n = len(element)
    take = min(TUPLE, n)
    best: np.ndarray | None = None
    value: np.ndarray | None = None
    for a in range(0, n, _BLOCK):
        part = row_hash(element[a : a + _BLOCK], slice(None))
        k = min(take, part.shape[1])
        at = np.argpartition(part, k - 1, axis=1)[:, :k] if k < part.shape[1] else np.tile(np.arange(k), (ROWS, 1))
        val = np.take_along_axis(part, at, 1)
        at = at + a
        if best is not None:
            at, val = np.hstack([best, at]), np.hstack([value, val])
            keep = np.argsort(val, axis=1, kind="stable")[:, :take]
            at, val = np.take_along_axis(at, keep, 1), np.take_along_axis(val, keep, 1)
        best, value = at, val
    return np.sort(best, axis=1)


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures one after another (``ROWS`` for each text that isn't empty) and the number of k-mers of each text."""
    kmer, off = kmers(text)
    element = mix(kmer ^ mix(occurrences(kmer, off) + U64(0x1D)))
    chosen = []
    for s, e in zip(off[:-1], off[1:]):
        if e > s:
            at = least(element[s:e]) + s
            chosen.append(at if at.shape[1] == TUPLE else np.hstack([at, np.full((ROWS, TUPLE - at.shape[1]), -1)]))
    if not chosen:
        return np.zeros(0, U64), np.diff(off)
    at = np.vstack(chosen)
    sig = np.tile(np.arange(ROWS, dtype=U64), len(chosen))
    for j in range(TUPLE):
        sig = mix(sig * U64(0xD6E8FEB86659FD93) + np.where(at[:, j] >= 0, element[at[:, j]], U64(0)))
    return sig, np.diff(off)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    null = np.asarray(batch.column(1).is_null())
    sig, n = signatures(batch.column(1).fill_null(""))
    off = np.concatenate([[0], np.cumsum(np.where(n > 0, ROWS, 0))])
    fold = np.zeros(len(n), dtype=U64)
    if len(sig):
        fold[n > 0] = mix(np.bitwise_xor.reduceat(mix(sig + np.tile(np.arange(ROWS, dtype=U64), len(sig) // ROWS)), off[:-1][n > 0]))
    lists = list_array(signed(sig), off, pa.int64())
    if null.any():
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=np.append(null, False)), lists.values)
    return pa.record_batch([batch.column(0), pa.array(n.astype(np.int32), mask=null), lists, pa.array(signed(fold), mask=null)], names=["doc_id", "n_kmers", "signature", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Signature of every document and one hash of it; equal texts have equal ones."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(rows, ["doc_id", "text"], "text", _sign, SCHEMA)


def similarity(a: str, b: str) -> Column:
    """Share of the rows in which the signatures of columns ``a`` and ``b`` agree; null unless both have one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.lit(float(ROWS)))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
