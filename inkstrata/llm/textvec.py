"""Vectorised text primitives shared by the training-data operators.

Whole Arrow string columns are treated as one byte buffer: words, hashes and
n-grams of thousands of documents are found with a few numpy passes and no
per-word Python objects.

A *word* is a maximal run of ASCII letters, digits, ``_`` and non-ASCII
characters, except the punctuation U+00A0, U+00AB, U+00BB, U+2000-U+203F and
U+3000-U+303F. Words are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW: list[np.ndarray] = []
#: Bytes of text handled at once inside one Python worker.
CHUNK_BYTES = 1 << 20

_WORD_BYTE = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _WORD_BYTE[_c] = True
_WORD_BYTE[128:] = True

#: The same definition of a word as a pattern, for one text at a time.
WORD_PATTERN = r"(?:[0-9A-Za-z_]|[^\x00-\x7f «» -‿　-〿])+"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _POW[:] = [np.multiply.accumulate(np.full(size, b, dtype=U64)) for b in (_P, _PINV)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and the bytes of a null-free string array."""
    arr = arr.cast(pa.large_utf8())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.empty(0, dtype=np.uint8)
    return off - off[0], flat


class Words:
    """Words of an Arrow string array; nulls count as empty texts.

    ``start``/``end`` are byte positions in ``buf``; ``doc`` is the row of each
    word; ``off[i]:off[i + 1]`` are the words of row ``i``; ``hash`` is 64 bits.
    """

    def __init__(self, arr: pa.Array, lower: bool = True):
        arr = arr.fill_null("") if arr.null_count else arr
        if lower:
            arr = pc.utf8_lower(arr)
        self.text_off, self.buf = utf8_parts(arr)
        n, b = len(self.buf), self.buf
        is_word = _WORD_BYTE[b]
        if n and b.max() >= 0x80:
            _drop_punctuation(b, is_word)
        mark = np.zeros(n + 2, dtype=bool)
        mark[1 : n + 1] = is_word
        cuts = self.text_off[1:-1]
        edge = mark[1:] != mark[:-1]
        inside = cuts[(cuts > 0) & (cuts < n)]
        inside = np.unique(inside[is_word[inside - 1] & is_word[inside]]) if len(inside) else inside
        if len(inside):  # two texts whose adjoining ends are both words
            at = np.flatnonzero(edge)
            at = np.sort(np.concatenate([at, inside, inside]))
        else:
            at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        self.off = np.searchsorted(self.start, self.text_off)
        self.n = len(self.text_off) - 1
        self.counts = np.diff(self.off)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), self.counts)
        self._cum: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``start`` to ``end``, equal for equal bytes."""
        n = len(self.buf)
        fwd, inv = _powers(n + 1)
        if self._cum is None:
            self._cum = np.zeros(n + 1, dtype=U64)
            np.cumsum((self.buf.astype(U64) + U64(1)) * fwd[:n], out=self._cum[1:])
        return mix((self._cum[end] - self._cum[start]) * inv[start])

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def shifted(self, k: int) -> np.ndarray:
        """Hash of the word ``k`` further on in the same row, 0 beyond its end."""
        h = np.zeros_like(self.hash)
        if len(h) > k:
            same = self.doc[k:] == self.doc[:-k]
            h[:-k][same] = self.hash[k:][same]
        return h

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of word n-grams and row offsets; a shorter row has one gram of all it has."""
        g = mix(self.hash + U64(n))
        for k in range(1, n):
            g = mix(g ^ (self.shifted(k) * U64(0xD6E8FEB86659FD93) + U64(k)))
        room = np.where(self.counts > 0, np.maximum(self.counts - n + 1, 1), 0)
        if len(g) == 0:
            return g, np.zeros(self.n + 1, dtype=np.int64)
        pos = np.arange(len(g)) - np.repeat(self.off[:-1], self.counts)
        keep = pos < np.repeat(room, self.counts)
        return g[keep], np.concatenate([[0], np.cumsum(room)])


def _drop_punctuation(b: np.ndarray, is_word: np.ndarray) -> None:
    at = np.flatnonzero((b[:-1] == 0xE2) | (b[:-1] == 0xE3) | (b[:-1] == 0xC2))
    if not len(at):
        return
    lead, second = b[at], b[at + 1]
    two = at[(lead == 0xC2) & ((second == 0xA0) | (second == 0xAB) | (second == 0xBB))]
    three = at[(lead != 0xC2) & (second == 0x80)]
    for where, k in ((two, 2), (three, 3)):
        for j in range(k):
            is_word[where + j] = False


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs of about ``max_bytes`` of text; no row is split."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = (np.cumsum(size) - size) // max_bytes
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, z in zip(cut[:-1], cut[1:]):
        yield batch.slice(a, z - a)


def map_text(df: DataFrame, columns: list[str], text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``fn`` over Arrow slices of ``columns``; only these columns leave the JVM."""
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, max_bytes):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def ensure_checkpoint(spark: SparkSession) -> None:
    """Uses the folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    where = sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="inkstrata-checkpoint-")
    sc.setCheckpointDir(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; one that is not there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
