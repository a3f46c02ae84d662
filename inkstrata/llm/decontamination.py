"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all 32-word passages.
2. A single-pass randomised SVD of the TF-IDF passage matrix A (idf enters
   squared, which keeps frequent words from filling the leading space): every
   task adds up A'(A*Omega) and (A*Omega)'(A*Omega), whose sizes do not depend
   on the corpus, and the driver solves a problem of ``RANK + OVERSAMPLE`` rows.
3. Benchmark items and overlapping windows of all texts, as long as the items
   and four words (eight for long ones) apart, are compared by latent cosine;
   every window-item pair of at least ``MIN_COSINE`` is a candidate.
4. Candidates are verified on the words themselves: the longest common
   subsequence of item and window, and of the item's answer (its last sentence)
   and window. A document leaks an item if ``VERBATIM`` of the item's words are
   there in order, or ``PARAPHRASE`` of them together with ``ANSWER`` of the answer.

Items of more than 64 words are probed in equal parts; each part counts alone.
Defined results: null or wordless texts and items leak nothing; null doc_ids
keep their row with a null id; repeated document rows repeat their leaks,
repeated items (same id) count by their best part: the greatest overlap, then
answer, then cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.textvec import U64, Words, map_text, slices, table

DIM = 1 << 14
PASSAGE = 32
RANK, OVERSAMPLE = 32, 8
TILE = 4
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16])  # window lengths in tiles
MIN_COSINE = 0.5
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
SLACK = 6  # words of context on either side of a window that its check may use
_SLACK_TILES = -(-SLACK // TILE)
#: Items compared in one pass over the texts; a larger benchmark takes several passes.
ITEMS_PER_PASS = 4096
_GROUP, _BLOCK, _TILES = 8192, 1024, 2048  # words, sums and tiles per inner block, so that the vectors at work stay in cache
_SLICE = 1 << 19  # bytes of text handled at once
_PROBES = 64  # probes compared with all windows of a slice at once
_PAIRS = 2048  # windows and probes verified at once
_HIGH = U64(0x8080808080808080)

SCHEMA = "doc_id bigint, item_id bigint, cosine double, overlap double, answer double"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(40)).astype(np.int64) & (DIM - 1)


def _passages(w: Words) -> np.ndarray:
    """The passage of each word, numbered through the rows."""
    pos = np.arange(len(w.doc)) - np.repeat(w.off[:-1], w.counts)
    return np.cumsum(pos % PASSAGE == 0) - 1


def _text_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") > 0)


def passage_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each hashed word occurs, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0, _SLICE):
                w = Words(part.column(0))
                if len(w.doc) == 0:
                    continue
                p = _passages(w)
                key = np.sort((p * DIM + _slot(w.hash)).astype(np.uint32 if p[-1] < (1 << 18) else np.uint64))
                first = np.concatenate([[True], key[1:] != key[:-1]])
                df += np.bincount((key[first] & (DIM - 1)).astype(np.int64), minlength=DIM)
                total += int(p[-1]) + 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], names=["slot", "n"])

    rows = _text_only(docs).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    df = np.zeros(DIM, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return df, int(n[slot < 0].sum())


def inverse_frequencies(df: np.ndarray, total: int) -> np.ndarray:
    return np.maximum(np.log((1 + total) / (1 + df)), 0.1) ** 2  # a word of all passages still counts a little


def _sums(m: np.ndarray, slot: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``m[slot]`` from each start to the next; the last row of ``m`` is zero."""
    size = np.diff(np.append(starts, len(slot)))
    out = np.zeros((len(starts), m.shape[1]), m.dtype)
    padded = np.append(slot, len(m) - 1)
    taken = np.empty((min(_BLOCK, len(starts)), m.shape[1]), m.dtype)
    for a in range(0, len(starts), _BLOCK):
        at, n, part = starts[a : a + _BLOCK], size[a : a + _BLOCK], out[a : a + _BLOCK]
        for j in range(int(n.max())):
            part += np.take(m, padded[np.where(j < n, at + j, len(slot))], axis=0, out=taken[: len(part)], mode="clip")
    return out


def _with_zero(m: np.ndarray) -> np.ndarray:
    return np.vstack([m, np.zeros((1, m.shape[1]), m.dtype)])


def sketch_matrix(docs: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """Right singular vectors (DIM x RANK) of the passage matrix from one pass over the texts."""
    l = RANK + OVERSAMPLE
    omega = _with_zero((idf[:, None] * np.random.default_rng(seed).standard_normal((DIM, l))).astype(np.float32))
    square = idf.astype(np.float64) ** 2

    def add(w: Words, acc: np.ndarray, gram: np.ndarray) -> None:
        p, slot = _passages(w), _slot(w.hash)
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        norm = np.sqrt(np.add.reduceat(square[slot], starts)) + 1e-12
        y = _sums(omega, slot, starts) / norm[:, None].astype(np.float32)
        gram += y.T.astype(np.float64) @ y
        y /= norm[:, None].astype(np.float32)
        # in the order of slots each row of acc is met about once
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        for a in range(0, len(order), _GROUP):
            at = order[a : a + _GROUP]
            by = slot[at]
            first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            acc[by[first]] += np.add.reduceat(np.take(y, p[at], axis=0, mode="clip"), first, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, gram = np.zeros((DIM, l), np.float32), np.zeros((l, l))
        for batch in batches:
            for part in slices(batch, 0, _SLICE):
                w = Words(part.column(0))
                if len(w.doc):
                    add(w, acc, gram)
        at = np.flatnonzero(acc.any(1))
        rows = np.vstack([acc[at].astype(np.float64), gram])
        yield pa.record_batch([pa.array(np.concatenate([at, DIM + np.arange(l)])), *[pa.array(rows[:, j]) for j in range(l)]], names=["slot", *[f"v{j}" for j in range(l)]])

    names = [f"v{j}" for j in range(l)]
    parts = _text_only(docs).mapInArrow(run, "slot bigint, " + ", ".join(f"{n} double" for n in names))
    rows = parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    full = np.zeros((DIM + l, l))
    full[rows.column(0).to_numpy()] = np.stack([rows.column(n).to_numpy() for n in names], 1)
    weighted, gram = full[:DIM] * idf[:, None], full[DIM:]
    gram += np.eye(l) * max(np.trace(gram), 1e-9) * 1e-9
    chol = np.linalg.cholesky(gram)
    b = np.linalg.solve(chol, weighted.T)  # Q'A
    value, left = np.linalg.eigh(b @ b.T)
    top = np.argsort(-value)[:RANK]
    return (b.T @ left[:, top]) / np.sqrt(np.maximum(value[top], 1e-12))


@dataclass
class Probes:
    """Benchmark parts of at most 64 words, ready for comparison; the size is in proportion to the items' words."""

    item: np.ndarray  # item_id of each probe
    size: np.ndarray
    length: np.ndarray  # index into LENGTHS
    vector: np.ndarray
    vocab: np.ndarray  # sorted word hashes; word k has number k + 1, 0 is any other word
    begin: np.ndarray  # the first word of ``vocab`` of each leading part of a hash
    off: np.ndarray  # the distinct words of probe k are number[off[k] : off[k + 1]]
    number: np.ndarray
    mask: np.ndarray  # positions of each such word in the probe
    tail: np.ndarray  # positions of the answer

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place in ``vocab`` of each hash, ``len(vocab)`` for other words."""
        lead = (h >> U64(65 - len(self.begin).bit_length())).view(np.int64)
        at = self.begin[lead].astype(np.int64)
        padded = np.append(self.vocab, ~U64(0))
        later = np.flatnonzero(padded[at] < h)
        while len(later):
            at[later] += 1
            later = later[padded[at[later]] < h[later]]
        return np.where(padded[at] == h, at, len(self.vocab))


def probes(items: pa.Table, projection: np.ndarray) -> Probes | None:
    items = items.filter(pa.compute.and_(pa.compute.is_valid(items.column(0)), pa.compute.is_valid(items.column(1))))
    if items.num_rows == 0:
        return None
    ids, text = items.column(0).to_numpy(), items.column(1).combine_chunks()
    w = Words(text)
    if len(w.doc) == 0:
        return None
    vocab = np.unique(w.hash)
    item, begin, size, answer = [], [], [], []
    raw = bytes(w.buf)
    for i in range(w.n):
        n = int(w.counts[i])
        if n == 0:
            continue
        a = int(w.off[i])
        # the answer: words after the last sentence end that has words on both sides
        last = n
        for j in range(n - 1, 0, -1):
            if any(c in b".?!:\n" for c in raw[w.end[a + j - 1] : w.start[a + j]]):
                last = j
                break
        parts = -(-n // 64)
        for k in range(parts):
            s, e = n * k // parts, n * (k + 1) // parts
            item.append(ids[i])
            begin.append(a + s)
            size.append(e - s)
            tail = range(max(last, s) - s, e - s) if last < e else range(max(0, (e - s) * 3 // 4), e - s)
            answer.append(sum(1 << j for j in tail))
    begin, size = np.array(begin), np.array(size)
    word = np.searchsorted(vocab, w.hash) + 1
    vector = np.zeros((len(item), RANK), np.float32)
    slot = _slot(w.hash)
    numbers, masks = [], []
    for k in range(len(item)):
        own = slice(begin[k], begin[k] + size[k])
        number, at = np.unique(word[own], return_inverse=True)
        mask = np.zeros(len(number), U64)
        np.bitwise_or.at(mask, at, U64(1) << np.arange(size[k], dtype=U64))
        numbers.append(number), masks.append(mask)
        v = projection[slot[own]].sum(0)
        vector[k] = v / (np.linalg.norm(v) + 1e-12)
    length = np.abs(np.log(np.maximum(size, 1)[:, None] / (LENGTHS[None] * TILE))).argmin(1)
    off = np.cumsum([0, *map(len, numbers)])
    bits = len(vocab).bit_length() + 2
    lead = np.searchsorted(vocab, np.arange(1 << bits, dtype=U64) << U64(64 - bits)).astype(np.int32)
    return Probes(np.array(item), size, length, vector, vocab, lead, off, np.concatenate(numbers), np.concatenate(masks), np.array(answer, dtype=U64))


def common_subsequence(seq: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a probe and each run ``seq[lo:hi]`` of words, given by their positions in the probe.

    Bit-parallel after Hyyro: one 64-bit addition for each word and run.
    """
    v = np.full(len(lo), ~U64(0))
    by = np.argsort(lo - hi, kind="stable")  # the longest first, so that the runs still going on are a prefix
    lo, size = lo[by], (hi - lo)[by]
    going = len(lo)
    for t in range(int(size[0]) if going else 0):
        while size[going - 1] <= t:
            going -= 1
        m = seq[lo[:going] + t]
        u = v[:going] & m
        v[:going] = (v[:going] + u) | (v[:going] - u)
    out = np.empty(len(by), np.int64)
    out[by] = np.bitwise_count(~v)
    return out


def _windows(within: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """Whether a window of ``k`` tiles begins at each tile, ``within`` its row and with ``left`` to go; a shorter row is one window."""
    fits = left >= k if k <= 8 else (left >= k) & ((within % 2 == 0) | (left == k))
    return fits | ((within == 0) & (left < k))


def _window_vectors(unit: np.ndarray, tile: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Unit vectors of windows of ``k`` tiles from ``tile``, up to the tile ``end`` of their row."""
    out = np.zeros((len(tile), unit.shape[1]), unit.dtype)
    for a in range(0, len(tile), _BLOCK):
        at, stop, part = tile[a : a + _BLOCK], end[a : a + _BLOCK], out[a : a + _BLOCK]
        for j in range(k):
            inside = at + j < stop
            part += unit[np.where(inside, at + j, 0)] * inside[:, None]
    return out / (np.sqrt(np.einsum("ij,ij->i", out, out)) + 1e-12)[:, None]


def _run_sums(x: np.ndarray, k: int, n: int) -> np.ndarray:
    """Sums of ``k`` consecutive rows of ``x`` from each of the first ``n`` on; ``x`` has ``n + k`` rows."""
    out, at, size = np.zeros((n, x.shape[1]), x.dtype), 0, 1
    while True:
        if k & size:
            out += x[at : at + n]
            at += size
        if 2 * size > k:
            return out
        x = x[:-size] + x[size:]
        size *= 2


def _shared_words(quads: np.ndarray, k: int, pr: Probes, own: np.ndarray) -> np.ndarray:
    """Which windows of ``k`` tiles may have ``PARAPHRASE`` of the words of the probes ``own``: the high bit of each probe's byte, for each tile.

    The number of the probe's words in the window's tiles and in those of its ``SLACK`` is no less than what the window has.
    Eight probes' numbers lie in one integer: at most 80 words and 127 to add to them can't carry over into the next byte.
    """
    member = np.zeros((len(pr.vocab) + 1, -(-len(own) // 8) * 8), np.uint8)
    for j, p in enumerate(own.tolist()):
        member[pr.number[pr.off[p] : pr.off[p + 1]] - 1, j] = 1
    lanes = member.view(U64)
    add = np.zeros(member.shape[1], np.uint8)
    add[: len(own)] = 128 - np.ceil(PARAPHRASE * pr.size[own] - 1e-9).astype(np.int64)
    add = add.view(U64)
    span = k + 2 * _SLACK_TILES  # tiles of a neighbouring row only add to the number
    out = np.empty((quads.shape[1] - _SLACK_TILES - int(LENGTHS[-1]) - _SLACK_TILES, lanes.shape[1]), U64)
    for a in range(0, len(out), _TILES):
        part = out[a : a + _TILES]
        near = quads[:, a : a + len(part) + span]
        x = np.take(lanes, near[0], axis=0, mode="clip")
        taken = np.empty_like(x)
        for words in near[1:]:
            x += np.take(lanes, words, axis=0, out=taken, mode="clip")
        np.bitwise_and(_run_sums(x, span, len(part)) + add, _HIGH, out=part)
    return out


def _leaked(word: np.ndarray, pr: Probes, probe: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the runs ``word[s:e]`` leak their probe, with overlap and answer; the runs of a probe follow one another.

    Words that a probe lacks cannot take part in a common subsequence: a run with fewer of the others than ``PARAPHRASE`` asks for is out.
    """
    bound = np.concatenate([[0], np.cumsum(e - s)])
    own = word[np.repeat(s - bound[:-1], e - s) + np.arange(bound[-1])]
    table, places = np.zeros(len(pr.vocab) + 1, U64), np.empty(len(own), U64)
    cut = [0, *(np.flatnonzero(np.diff(probe)) + 1).tolist(), len(probe)]
    for a, z in zip(cut[:-1], cut[1:]):
        mine = slice(pr.off[probe[a]], pr.off[probe[a] + 1])
        table[pr.number[mine] - 1] = pr.mask[mine]
        places[bound[a] : bound[z]] = table[own[bound[a] : bound[z]]]
        table[pr.number[mine] - 1] = 0
    hit = places != 0
    cum = np.concatenate([[0], np.cumsum(hit)])
    lo, hi, seq = cum[bound[:-1]], cum[bound[1:]], places[hit]
    tail = seq & np.repeat(pr.tail[probe], hi - lo)
    at = np.flatnonzero(hi - lo >= PARAPHRASE * pr.size[probe])
    share = common_subsequence(seq, lo[at], hi[at]) / pr.size[probe[at]]
    at, share = at[share >= PARAPHRASE], share[share >= PARAPHRASE]
    answer = common_subsequence(tail, lo[at], hi[at]) / np.maximum(np.bitwise_count(pr.tail[probe[at]]), 1)
    good = (share >= VERBATIM) | (answer >= ANSWER)
    return at[good], share[good], answer[good]


def find(w: Words, projection: np.ndarray, pr: Probes) -> list[np.ndarray]:
    """(row, item, cosine, overlap, answer) of what the texts leak, the best of each row and item.

    Every window and probe of at least ``MIN_COSINE`` is a candidate. Windows with too few of a probe's words are out before
    any cosine, and only tiles of the others get a vector.
    """
    none = [np.zeros(0)] * 5
    toff = np.concatenate([[0], np.cumsum(-(-w.counts // TILE))])
    n = int(toff[-1])
    if not n:
        return none
    row_of = np.repeat(np.arange(w.n), np.diff(toff))
    within = np.arange(n) - toff[row_of]
    left = np.diff(toff)[row_of] - within
    first, last = w.off[row_of] + within * TILE, w.off[row_of + 1]
    other = len(pr.vocab)
    word = pr.places(w.hash)
    slot = np.append(_slot(w.hash), len(projection) - 1)
    quads = np.full((TILE, _SLACK_TILES + n + int(LENGTHS[-1]) + _SLACK_TILES), other)
    for j in range(TILE):
        quads[j, _SLACK_TILES : _SLACK_TILES + n] = np.where(first + j < last, word[np.minimum(first + j, len(word) - 1)], other)
    unit, known = np.zeros((n, projection.shape[1]), projection.dtype), np.zeros(n, bool)

    def learn(tile: np.ndarray, k: int) -> None:
        """Vectors of the tiles of windows, where not yet known."""
        near = np.zeros(n, bool)
        for j in range(k):
            near[np.minimum(tile + j, n - 1)] = True
        at = np.flatnonzero(near & ~known)
        for a in range(0, len(at), _BLOCK):
            part = at[a : a + _BLOCK]
            unit[part] = sum(projection[slot[np.where(first[part] + j < last[part], first[part] + j, len(slot) - 1)]] for j in range(TILE))
        known[at] = True

    pairs: list[tuple] = []
    keep: list[tuple] = []

    def verify() -> None:
        """What of the pairs leaks; the pairs go."""
        if not pairs:
            return
        tile, probe, cosine = (np.concatenate(x) for x in zip(*pairs))
        pairs.clear()
        for a in range(0, len(tile), _PAIRS):
            at, p = tile[a : a + _PAIRS], probe[a : a + _PAIRS]
            end = np.minimum(first[at] + LENGTHS[pr.length[p]] * TILE, last[at])
            good, share, answer = _leaked(word, pr, p, np.maximum(first[at] - SLACK, w.off[row_of[at]]), np.minimum(end + SLACK, last[at]))
            keep.append((row_of[at[good]], pr.item[p[good]], cosine[a + good], share, answer))

    for li in np.unique(pr.length):
        same = np.flatnonzero(pr.length == li)
        k = int(LENGTHS[li])
        begins = _windows(within, left, k)
        for a in range(0, len(same), _PROBES):
            own = same[a : a + _PROBES]
            enough = _shared_words(quads, k, pr, own)
            some = np.zeros(n, U64)
            for j in range(enough.shape[1]):
                some |= enough[:, j]
            tile = np.flatnonzero((some != 0) & begins)
            if not len(tile):
                continue
            learn(tile, k)
            cosine = _window_vectors(unit, tile, tile + left[tile], k) @ pr.vector[own].T
            which, window = np.nonzero(((cosine >= np.float32(MIN_COSINE)) & (enough[tile].view(np.uint8)[:, : len(own)] != 0)).T)
            pairs.append((tile[window], own[which], cosine[window, which]))
            if sum(len(x[0]) for x in pairs) >= _PAIRS:
                verify()
    verify()
    if not keep:
        return none
    r, item, c, share, answer = (np.concatenate(k) for k in zip(*keep))
    order = np.lexsort((-c, -answer, -share, item, r))
    r, item, c, share, answer = r[order], item[order], c[order], share[order], answer[order]
    best = np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])]) if len(r) else np.zeros(0, bool)
    return [x[best] for x in (r, item, c, share, answer)]


def _passes(docs: DataFrame, benchmark: DataFrame) -> tuple[np.ndarray, list[Probes]]:
    """The latent projection and the probes of each pass over the texts."""
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = bench.count()
    if n == 0:
        return np.zeros((DIM + 1, RANK), np.float32), []
    df, total = passage_frequencies(docs)
    idf = inverse_frequencies(df, total)
    projection = _with_zero((idf[:, None] * sketch_matrix(docs, idf)).astype(np.float32))
    blocks = -(-n // ITEMS_PER_PASS)
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    made = [probes(bench.where(part == k).toArrow(), projection) for k in range(blocks)]
    return projection, [p for p in made if p is not None]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    projection, passes = _passes(docs, benchmark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(pr: Probes) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            row, item, cosine, share, answer = find(Words(batch.column(1)), projection, pr)
            if not len(row):
                return None
            rounded = [pa.array(np.round(x.astype(np.float64), 4)) for x in (cosine, share, answer)]
            return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(item.astype(np.int64)), *rounded], names=["doc_id", "item_id", "cosine", "overlap", "answer"])

        return map_text(docs, ["doc_id", "text"], "text", run, SCHEMA, _SLICE)

    if not passes:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    out = one(passes[0])
    for p in passes[1:]:
        out = out.unionByName(one(p))
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go."""
    projection, passes = _passes(docs, table(spark, sf_dir, "benchmark"))
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(at))
        clean = np.ones(batch.num_rows, bool)
        for pr in passes:
            clean[find(w, projection, pr)[0].astype(np.int64)] = False
        return batch.filter(pa.array(clean))

    return map_text(docs, docs.columns, "text", keep, docs.schema, _SLICE) if passes else docs
