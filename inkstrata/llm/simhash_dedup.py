"""SimHash near-duplicate groups found with navigable small-world graphs.

1. Each text becomes a 256-bit SimHash of its distinct word trigrams. Texts with
   the same words are copies; one representative of each such class goes on.
2. A shard holds the representatives that share one of ``TABLES`` min-wise
   hashes of their trigrams, so the shards that a text visits do not grow in
   number with the corpus. A shard of over ``SHARD_NODES`` members is dealt into
   blocks, each with a graph of its own, and its members are broadcast as
   queries to the graphs of the blocks before theirs.
3. In a shard a navigable small-world graph over Hamming distance is built. Every
   member is a query; beams expand until recall, audited against exact search
   over the whole shard, is reached, and a query whose whole beam lies within
   ``RADIUS`` is compared with all members, so that no number of neighbours is
   the limit; its pairs are verified as they come and never lie in memory at once.
   Up to ``GRAPH_FROM`` members the graph is complete: all pairs.
   Signatures alone are searched first; only members with a partner within
   ``RADIUS`` come again, to shards of such members, with their trigrams.
4. Every candidate pair is verified on the two texts' whole trigram sets (32-bit
   hashes) in the one shard that comes first among those the two share. Where
   pairs are many, bits for the shard's most frequent trigrams bound the number
   that two sets share, and only pairs between the bounds compare whole sets. The
   shard returns each member's number of links and its local root, not the pairs.
5. Local roots are united to groups by large-star and small-star steps.

Defined results: a null ``doc_id`` is never compared; a null or empty text has
no copies; texts without any word are copies if their bytes are equal; rows
equal in ``doc_id`` and text count once; a ``doc_id`` with differing texts has a
row for each text that has copies or links; of equal candidates to keep, the one
with the least ``doc_id``, then the least text hash, stays. A ``doc_id`` that is
no integer is an error of the cast. Classes have 64-bit numbers: of n classes,
two share a number with a probability of n * n / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.textvec import U64, Words, ensure_checkpoint, map_text, mix, signed, table

BITS = 256
SHINGLE = 3
TABLES = 6
RADIUS = 92
MIN_JACCARD = 0.5
#: Members of a shard up to which its graph would be all but complete and all pairs are compared.
GRAPH_FROM = 256
#: Nodes of one graph; a larger shard is dealt into blocks.
SHARD_NODES = 1 << 14
#: Nodes that are compared in the time that one place of a beam takes (measured: 12 ns a node, 6.7 us a place).
NODES_PER_PLACE = 512
#: Trigrams with a bit of their own in a shard, and pairs from which on bits are made.
BITMAP, BITMAP_FROM = 1024, 1 << 14
#: Blocks whose members query one build of a block's graph.
BLOCKS_PER_UNIT = 8
#: Rows of shards that one task should get.
ROWS_PER_TASK = 1 << 14
_DIM = 4096
_PLANES: list[np.ndarray] = []

SIGNATURE_SCHEMA = "doc_id bigint, h bigint, cls bigint, sig binary, keys array<bigint>"
GRAM_SCHEMA = "doc_id bigint, h bigint, grams binary"


def planes() -> np.ndarray:
    """Random +-1 rows, one for each trigram bucket; the same everywhere."""
    if not _PLANES:
        x = mix(np.arange(_DIM * BITS // 64, dtype=U64) + U64(0x5151))
        bits = np.unpackbits(x.view(np.uint8)).reshape(_DIM, BITS)
        _PLANES.append(bits.astype(np.float32) * 2 - 1)
    return _PLANES[0]


_KEY_SEEDS = mix(np.arange(1, TABLES + 1, dtype=U64) * U64(0xA0761D6478BD642F))


def _texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of doc_id, h, text that have an id and a text."""
    return batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.greater(pc.fill_null(pc.binary_length(batch.column(2)), 0), 0)))


def _trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word hashes and the sorted distinct trigram hashes of each text; a text without words counts as its characters."""
    w = Words(texts)
    g, off = w.grams(SHINGLE)
    for i in range(w.n):
        x, ids = g[off[i] : off[i + 1]], w.hash[w.off[i] : w.off[i + 1]]
        if len(x) == 0:
            raw = Words(pa.array(["".join(f"{ord(c):x} " for c in texts[i].as_py())]))
            x, ids = raw.grams(SHINGLE)[0] ^ U64(0xABCDEF), raw.hash ^ U64(0xFFFF)
        x = np.sort(x)
        yield ids, x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def sign_texts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """doc_id, h, text -> signature rows; rows without an id or a text are left out."""
    batch = _texts(batch)
    n = batch.num_rows
    if n == 0:
        return None
    acc = np.zeros((n, _DIM), dtype=np.float32)
    cls, keys = np.zeros(n, dtype=U64), np.zeros((n, TABLES), dtype=np.int64)
    for i, (ids, x) in enumerate(_trigrams(batch.column(2))):
        pos = np.arange(1, len(ids) + 1, dtype=U64)
        cls[i] = mix(ids * (pos * U64(0x9E3779B97F4A7C15) | U64(1)) + U64(1)).sum(dtype=U64)
        acc[i] = np.bincount((x & U64(_DIM - 1)).astype(np.int64), weights=((x >> U64(12)) & U64(1)).astype(np.float32) * 2 - 1, minlength=_DIM)
        keys[i] = signed((x[None, :] * _KEY_SEEDS[:, None]).min(1))
    bits = np.packbits(acc @ planes() > 0, axis=1)
    off = np.arange(0, TABLES * (n + 1), TABLES, dtype=np.int32)
    return pa.record_batch([batch.column(0), batch.column(1), pa.array(signed(cls)), pa.array([r.tobytes() for r in bits], pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel()))], names=["doc_id", "h", "cls", "sig", "keys"])


def gram_sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """doc_id, h, text -> the sorted distinct 32-bit trigram hashes of each text."""
    batch = _texts(batch)
    if batch.num_rows == 0:
        return None
    sets = [np.unique((x >> U64(32)).astype(np.uint32)).tobytes() for _, x in _trigrams(batch.column(2))]
    return pa.record_batch([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["doc_id", "h", "grams"])


def _keyed(docs: DataFrame, doc_id: str | Column, text: str) -> DataFrame:
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    body = F.col(text).cast("string")
    return docs.select(id_.cast("bigint").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))


def signatures(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text") -> DataFrame:
    return map_text(_keyed(docs, doc_id, text), ["doc_id", "h", "text"], "text", sign_texts, SIGNATURE_SCHEMA)


# --- the graph ------------------------------------------------------------------------------


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def within(q: np.ndarray, pool: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``q``, row of ``pool``) of all pairs within ``radius``, in parts."""
    step = max(1, (1 << 20) // max(len(pool), 1))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        d = np.zeros((len(part), len(pool)), dtype=np.uint16)
        for k in range(part.shape[1]):
            d += np.bitwise_count(part[:, k, None] ^ pool[None, :, k])
        row, col = np.nonzero(d <= radius)
        yield row + a, col


class SmallWorld:
    """A navigable small-world graph over packed signatures, searched in bulk."""

    LINKS = 8
    PROBES = 64

    def __init__(self, sig: np.ndarray, seed: int = 7):
        self.sig, self.n = sig, len(sig)
        self.order = np.random.default_rng(seed).permutation(self.n)
        self.adj = np.full((self.n, 3 * self.LINKS), -1, dtype=np.int64)
        done = min(self.n, 64)
        self._link(self.order[:done], self._exact(self.order[:done], self.order[:done]))
        while done < self.n:
            new = self.order[done : done + min(done, 1024)]
            far = self.search(sig[new], self._spread(len(new), done), 2 * self.LINKS)
            self._link(new, self._closest(new, np.hstack([far, self._exact(new, new)]), self.LINKS))
            done += len(new)
        self.beam, self.recall = 16, 1.0

    def _spread(self, count: int, done: int, k: int = 16) -> np.ndarray:
        """``k`` entry nodes, spread evenly over the first ``done`` and turned from query to query, for each of ``count`` queries."""
        k = min(k, done)
        return self.order[(np.arange(count)[:, None] * 7 + np.arange(k)[None] * (done // k)) % done]

    def _exact(self, q: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """The closest LINKS of ``pool`` for each of ``q``."""
        out = np.full((len(q), self.LINKS), -1, dtype=np.int64)
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            d = hamming(self.sig[part][:, None], self.sig[pool][None])
            d[part[:, None] == pool[None]] = BITS + 1
            k = min(self.LINKS, len(pool) - 1)
            if k > 0:
                out[a : a + len(part), :k] = pool[np.argpartition(d, k - 1, axis=1)[:, :k]]
        return out

    def _closest(self, q: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[found == q[:, None]] = -1
        d = np.where(found >= 0, hamming(self.sig[q][:, None], self.sig[found]), BITS + 1)
        return np.take_along_axis(found, np.argsort(d, axis=1, kind="stable")[:, :k], 1)

    def _link(self, q: np.ndarray, to: np.ndarray) -> None:
        """Forward links to ``to``; backward links while the other end has room."""
        k = self.LINKS
        self.adj[q, : to.shape[1]] = to
        src, dst = np.repeat(q, to.shape[1]), to.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        at = np.arange(len(dst))
        rank = at - np.maximum.accumulate(np.where(np.concatenate([[True], dst[1:] != dst[:-1]]), at, 0))
        used = (self.adj[dst, k:] >= 0).sum(1)
        ok = used + rank < 2 * k
        self.adj[dst[ok], k + used[ok] + rank[ok]] = src[ok]

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
        """Best-first search for all signatures ``q`` at once from ``entry``; the ``beam`` closest found, -1 beyond."""
        out = np.full((len(q), beam), -1, dtype=np.int64)
        step = max(1, (1 << 20) // (beam * 48))
        for a in range(0, len(q), step):
            out[a : a + step] = self._search(q[a : a + step], entry[a : a + step], beam)
        return out

    def _search(self, q: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        k = min(beam, entry.shape[1])
        ids[:, :k] = entry[:, :k]
        dist = np.where(ids >= 0, hamming(q[:, None], self.sig[ids]), BITS + 1)
        open_ = ids >= 0
        live = np.arange(len(q))
        while len(live):
            d = np.where(open_[live], dist[live], BITS + 1)
            pick = d.argmin(1)
            ok = d[np.arange(len(live)), pick] <= BITS
            live, pick = live[ok], pick[ok]
            if not len(live):
                break
            node = ids[live, pick]
            open_[live, pick] = False
            near = self.adj[node]
            seen = (near[:, :, None] == ids[live][:, None, :]).any(2) | (near < 0)
            nd = np.where(seen, BITS + 1, hamming(q[live][:, None], self.sig[near]))
            # the beam keeps the closest; the farther ones, expanded or not, drop out
            all_ids = np.hstack([ids[live], np.where(seen, -1, near)])
            all_d = np.hstack([dist[live], nd])
            all_open = np.hstack([open_[live], ~seen])
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            dist[live] = np.take_along_axis(all_d, keep, 1)
            open_[live] = np.take_along_axis(all_open, keep, 1) & (dist[live] <= BITS)
        return ids

    def audit(self, radius: int, target: float = 0.98) -> None:
        """Sets ``beam`` to the least that finds ``target`` of all pairs within ``radius`` of evenly spaced probes, ``recall`` to that share.

        A beam of a sixteenth of the shard, or one doubled to over a ``NODES_PER_PLACE``-th of it, costs more than exact
        search; then ``beam`` is the whole shard and recall 1.
        """
        probe = self.order[:: max(1, self.n // self.PROBES)]
        want = sum(len(a) for a, _ in within(self.sig[probe], self.sig, radius)) - len(probe)  # less themselves
        self.beam = 16
        while self.beam * 16 < self.n and (self.beam == 16 or self.beam * NODES_PER_PLACE < self.n):
            got = sum(int((b != probe[a]).sum()) for a, b in self.range(self.sig[probe], radius, probe))
            self.recall = got / want if want else 1.0
            if got >= target * want:
                return
            self.beam *= 2
        self.beam, self.recall = self.n, 1.0

    def range(self, q: np.ndarray, radius: int, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``q``, node) within ``radius``; where the whole beam is that near there may be more, and all nodes are compared.

        Queries that are the nodes ``own`` enter at their own links, others at nodes spread over the graph.
        """
        for a in range(0, len(q), 4096):
            part = q[a : a + 4096]
            rest = np.arange(len(part))
            if self.beam < self.n:
                row, col, full = self._beamed(part, radius, None if own is None else own[a : a + 4096])
                yield row + a, col
                rest = np.flatnonzero(full)
            for row, col in within(part[rest], self.sig, radius):
                yield rest[row] + a, col

    def _beamed(self, q: np.ndarray, radius: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``q``, node) within ``radius`` by the beam, less the rows whose whole beam is that near, and which those are."""
        entry = self._spread(len(q), self.n, self.beam) if own is None else self.adj[own, : self.LINKS]
        found = self.search(q, entry, self.beam)
        near = np.where(found >= 0, hamming(q[:, None], self.sig[found]), BITS + 1)
        full = near.max(1) <= radius
        row, col = np.nonzero((near <= radius) & ~full[:, None])
        return row, found[row, col], full

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of nodes that ``range`` finds from either side, each once.

        A node with a full beam finds all its pairs, which need no memory; those of the others, of whom each has fewer than
        ``beam``, are held until both sides are there.
        """
        full, codes = np.ones(self.n, bool), []
        for a in range(0, self.n if self.beam < self.n else 0, 4096):
            own = np.arange(a, min(a + 4096, self.n))
            row, col, full[own] = self._beamed(self.sig[own], radius, own)
            row, col = own[row], col.astype(np.int64)
            row, col = row[row != col], col[row != col]
            codes.append(np.unique(np.minimum(row, col) * self.n + np.maximum(row, col)))
        if codes:
            i, j = np.divmod(np.unique(np.concatenate(codes)), self.n)
            rest = ~(full[i] | full[j])
            i, j = i[rest], j[rest]
            for a in range(0, len(i), 1 << 20):
                yield i[a : a + (1 << 20)], j[a : a + (1 << 20)]
        all_ = np.flatnonzero(full)
        for i, j in within(self.sig[all_], self.sig, radius):
            i = all_[i]
            once = (i < j) | ~full[j]
            yield i[once], j[once]


# --- verified links of a shard ---------------------------------------------------------------


class Members:
    """Rows of a shard as arrays; trigram sets lie end to end in ``grams``."""

    def __init__(self, cls: np.ndarray, sig: np.ndarray, keys: np.ndarray, off: np.ndarray, grams: np.ndarray):
        self.cls, self.sig, self.keys, self.off, self.grams = cls, sig, keys, off, grams

    def __len__(self) -> int:
        return len(self.cls)

    @staticmethod
    def of(rows: pa.RecordBatch) -> Members:
        """From the columns cls, sig, keys and grams of ``rows``; repeated classes count once."""
        cls = rows.column("cls").to_numpy()
        if len(cls) > 1 and (cls[1:] == cls[:-1]).any():
            rows = rows.filter(pa.array(np.concatenate([[True], cls[1:] != cls[:-1]])))
            cls = rows.column("cls").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=U64).reshape(-1, BITS // 64)
        keys = rows.column("keys").flatten().to_numpy().reshape(-1, TABLES)
        sets = rows.column("grams").to_pylist() if "grams" in rows.schema.names else [b""] * len(cls)
        off = np.concatenate([[0], np.cumsum([len(s) // 4 for s in sets])]).astype(np.int64)
        return Members(cls, sig, keys, off, np.frombuffer(b"".join(sets), dtype=np.uint32))

    def slice(self, s: int, e: int) -> Members:
        return Members(self.cls[s:e], self.sig[s:e], self.keys[s:e], self.off[s : e + 1] - self.off[s], self.grams[self.off[s] : self.off[e]])

    @staticmethod
    def joined(parts: list[Members]) -> Members:
        if len(parts) == 1:
            return parts[0]
        ends = np.cumsum([0, *(len(p.grams) for p in parts)])
        off = np.concatenate([[0], *(p.off[1:] + e for p, e in zip(parts, ends))])
        return Members(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("cls", "sig", "keys")), off, np.concatenate([p.grams for p in parts]))


class Bits(NamedTuple):
    """Members by a ``Bitmap``: packed bits, and end to end in ``grams`` the numbers of the trigrams that have no bit."""

    packed: np.ndarray
    off: np.ndarray
    grams: np.ndarray


class Bitmap:
    """Bits for the ``BITMAP`` trigrams that most nodes have; trigrams that can be in no pair are left out."""

    def __init__(self, nodes: Members):
        self.members = nodes
        self.values, number = np.unique(nodes.grams, return_counts=True)
        held = np.argsort(-number, kind="stable")[:BITMAP]
        self.place = np.full(len(self.values) + 1, -1, np.int32)  # the last one: a trigram that no node has
        self.place[held] = np.arange(len(held))
        self.nodes = self.of(nodes, np.append(number > 1, False))  # for pairs of nodes
        self.whole: Bits | None = None

    def pair(self, q: Members | None) -> tuple[Bits, Bits]:
        """For pairs of ``q``, or of the nodes themselves, and the nodes."""
        if q is None:
            return self.nodes, self.nodes
        self.whole = self.whole or self.of(self.members)
        return self.of(q), self.whole

    def of(self, m: Members, known: np.ndarray | None = None) -> Bits:
        """Trigrams without a bit count where ``known``; by default where a node has them."""
        known = np.append(np.ones(len(self.values), bool), False) if known is None else known
        packed, number, rest = np.zeros((len(m), BITMAP // 64), U64), np.zeros(len(m), np.int64), []
        part = m.off[:-1] >> 20  # members of about a million trigrams at once
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(m)]])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            grams, row = m.grams[m.off[s] : m.off[e]], np.repeat(np.arange(e - s), np.diff(m.off[s : e + 1]))
            at = np.minimum(np.searchsorted(self.values, grams), len(self.values) - 1)
            at[self.values[at] != grams] = len(self.values)
            place, own = self.place[at], np.zeros((e - s, BITMAP), bool)
            own[row[place >= 0], place[place >= 0]] = True
            packed[s:e] = np.packbits(own, axis=1).view(U64)
            more = (place < 0) & known[at]
            number[s:e] = np.bincount(row[more], minlength=e - s)
            rest.append(at[more].astype(np.int32))
        return Bits(packed, np.concatenate([[0], np.cumsum(number)]), np.concatenate(rest))


def _with_bits(a: Bits, b: Bits, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of trigrams with a bit that ``i`` of ``a`` and ``j`` of ``b`` share."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 13):
        out[s : s + (1 << 13)] = np.bitwise_count(a.packed[i[s : s + (1 << 13)]] & b.packed[j[s : s + (1 << 13)]]).sum(1, dtype=np.int64)
    return out


def similar(q: Members, nodes: Members, i: np.ndarray, j: np.ndarray, bits: tuple[Bits, Bits] | None = None) -> np.ndarray:
    """Whether the trigram sets of ``q[i]`` and ``nodes[j]`` reach ``MIN_JACCARD``; exact. ``bits`` are those of both by one ``Bitmap``."""
    a, b = np.diff(q.off)[i], np.diff(nodes.off)[j]
    out = np.minimum(a, b) >= MIN_JACCARD * np.maximum(a, b)
    at = np.flatnonzero(out)
    known = np.zeros(len(i), np.int64)
    left, right = bits or (q, nodes)
    if bits:
        least = known[at] = _with_bits(left, right, i[at], j[at])
        both = a[at] + b[at]
        most = least + np.minimum(np.diff(left.off)[i[at]], np.diff(right.off)[j[at]])
        out[at] = least >= MIN_JACCARD * (both - least)
        at = at[~out[at] & (most >= MIN_JACCARD * (both - most))]
    at = at[np.argsort(i[at], kind="stable")]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(i[at])) + 1, [len(at)]]) if len(at) else [0]
    for s, e in zip(cut[:-1], cut[1:]):
        for lo in range(s, e, 512):
            pairs = at[lo : min(lo + 512, e)]
            x = left.grams[left.off[i[pairs[0]]] : left.off[i[pairs[0]] + 1]]
            size = right.off[j[pairs] + 1] - right.off[j[pairs]]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            y = right.grams[np.repeat(right.off[j[pairs]] - start, size) + np.arange(size.sum())] if len(pairs) > 1 else right.grams[right.off[j[pairs[0]]] : right.off[j[pairs[0]] + 1]]
            place = np.searchsorted(x, y)
            both = known[pairs] + np.add.reduceat(x[np.minimum(place, len(x) - 1)] == y, start, dtype=np.int64)
            out[pairs] = both >= MIN_JACCARD * (a[pairs] + b[pairs] - both)
    return out


class Links:
    """Numbers of links and local roots of the members met in a shard."""

    def __init__(self) -> None:
        self.count: dict[int, int] = {}
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        r = self.root
        while r.setdefault(x, x) != x:
            r[x] = r[r[x]]
            x = r[x]
        return x

    def add(self, cls: np.ndarray, number: np.ndarray, label: np.ndarray) -> None:
        """Members with ``number`` more links, each joined to the member in the row ``label``."""
        for c, n, y in zip(cls.tolist(), number.tolist(), cls[label].tolist()):
            if n:
                self.count[c] = self.count.get(c, 0) + n
                p, q = self.find(c), self.find(y)
                if p != q:
                    self.root[max(p, q)] = min(p, q)

    def __len__(self) -> int:
        return len(self.count)

    def rows(self) -> pa.RecordBatch:
        own = sorted(self.count)
        return pa.record_batch([pa.array(own, pa.int64()), pa.array([self.find(x) for x in own], pa.int64()), pa.array([self.count[x] for x in own], pa.int64())], names=["cls", "root", "links"])


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, where each element has the least row of its component, after the components of ``a[k]`` and ``b[k]`` are joined."""
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class Near:
    """Members of a table's shards that have a partner within ``RADIUS``."""

    def __init__(self) -> None:
        self.seen: dict[tuple[int, int], set[int]] = {}
        self.size = 0

    def add(self, shard: tuple[int, int], cls: np.ndarray) -> None:
        own = self.seen.setdefault(shard, set())
        self.size -= len(own)
        own.update(cls.tolist())
        self.size += len(own)

    def rows(self) -> pa.RecordBatch:
        t, key, cls = ([*x] for x in zip(*((t, key, c) for (t, key), own in self.seen.items() for c in own)))
        return pa.record_batch([pa.array(t, pa.int32()), pa.array(key, pa.int64()), pa.array(cls, pa.int64())], names=["t", "key", "cls"])

    def __len__(self) -> int:
        return self.size


class Shard:
    """One unit of work: the nodes of a block, then the queries broadcast to it."""

    def __init__(self, t: int, key: int, own: bool, links: Links | Near, radius: int = RADIUS):
        self.t, self.key, self.own, self.links, self.radius = t, key, own, links, radius
        self.parts: list[Members] = []
        self.nodes: Members | None = None
        self.world: SmallWorld | None = None
        self.bitmap: Bitmap | None = None

    def _first_here(self, q: Members, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs that share no min-wise hash of a table before this one."""
        ok = np.ones(len(i), bool)
        for s in range(self.t):
            ok &= q.keys[i, s] != self.nodes.keys[j, s]
        return ok

    def _verify(self, q: Members, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes the pairs ``found`` of ``q`` and the nodes; counts and components are of rows, those of the nodes first, until all are there."""
        n, shift = len(self.nodes), 0 if q is self.nodes else len(self.nodes)
        number, label = np.zeros(shift + len(q), np.int64), np.arange(shift + len(q))
        bits = None
        for i, j in found:
            ok = self._first_here(q, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if isinstance(self.links, Near):
                number[i + shift] = number[j] = 1
                continue
            if bits is None and len(i) >= BITMAP_FROM and len(self.nodes.grams):
                self.bitmap = self.bitmap or Bitmap(self.nodes)
                bits = self.bitmap.pair(None if q is self.nodes else q)
            ok = similar(q, self.nodes, i, j, bits)
            i, j = i[ok] + shift, j[ok]
            number += np.bincount(i, minlength=len(number)) + np.bincount(j, minlength=len(number))
            label = joined_labels(label, i, j)
        cls = self.nodes.cls if q is self.nodes else np.concatenate([self.nodes.cls, q.cls])
        if isinstance(self.links, Near):
            self.links.add((self.t, self.key), cls[number > 0])
        elif number.any():
            self.links.add(cls, number, label)

    def build(self) -> None:
        """The graph, and the links among its own nodes where this unit has to find them."""
        self.nodes = Members.joined(self.parts)
        self.parts = []
        n = len(self.nodes)
        if n > GRAPH_FROM:
            self.world = SmallWorld(self.nodes.sig)
            self.world.audit(self.radius)
        if not self.own or n < 2:
            return
        self._verify(self.nodes, self.world.pairs(self.radius) if self.world is not None else self._all_pairs())

    def _all_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in within(self.nodes.sig, self.nodes.sig, self.radius):
            yield i[i < j], j[i < j]

    def query(self, q: Members) -> None:
        if self.nodes is None:
            if not self.parts:  # no member has this block
                return
            self.build()
        self._verify(q, self.world.range(q.sig, self.radius) if self.world is not None else within(q.sig, self.nodes.sig, self.radius))


LINK_SCHEMA = "cls bigint, root bigint, links bigint"
NEAR_SCHEMA = "t int, key bigint, cls bigint"


def _links_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (t, key, unit, own, query, cls, sig, keys, grams), sorted by the first three, nodes before queries -> links and local roots."""
    yield from _of_shards(batches, Links)


def _near_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows without trigrams -> members with a partner within ``RADIUS``, once for each unit of work or more."""
    yield from _of_shards(batches, Near)


def _of_shards(batches: Iterator[pa.RecordBatch], kind: type[Links] | type[Near]) -> Iterator[pa.RecordBatch]:
    shard: Shard | None = None
    at: tuple | None = None
    links = kind()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t, key, unit, query = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("t", "key", "unit", "query"))
        change = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (unit[1:] != unit[:-1]) | (query[1:] != query[:-1])) + 1
        cut = np.concatenate([[0], change, [batch.num_rows]])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            here = (int(t[s]), int(key[s]), int(unit[s]))
            if here != at:
                if shard is not None and shard.parts:
                    shard.build()
                if len(links) > 1 << 16:
                    yield links.rows()
                    links = kind()
                at, shard = here, Shard(here[0], here[1], bool(batch.column("own")[s].as_py()), links)
            part = Members.of(batch.slice(s, e - s))
            if query[s]:
                shard.query(part)
            else:
                shard.parts.append(part)
    if shard is not None and shard.parts:
        shard.build()
    if len(links):
        yield links.rows()


def shard_rows(reps: DataFrame, live: DataFrame, grams: DataFrame | None, tasks: int, nodes: int = SHARD_NODES) -> DataFrame:
    """The rows of every unit of work, with trigrams where ``grams`` are given, sorted within its partition.

    A shard of n members has ceil(n / ``nodes``) blocks. Member of block b: node of the units (b, 0 .. b / BLOCKS_PER_UNIT),
    the last of which finds the links within the block, and query to one unit of every later block.
    """
    blocks = F.ceil(F.col("n") / nodes).cast("int")
    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / nodes)).cast("int")
    routes = live.select("cls", F.struct("t", "key", blocks.alias("blocks"), block.alias("block")).alias("r")).groupBy("cls").agg(F.collect_list("r").alias("routes"))
    rows = reps.join(routes, "cls")
    if grams is not None:
        rows = rows.join(grams, ["doc_id", "h"])
    body = ["cls", "sig", "keys", *([] if grams is None else ["grams"])]
    rows = rows.select(*body, F.explode("routes").alias("r"))
    unit = lambda b, g: b.cast("bigint") * (1 << 24) + g
    group = F.floor(F.col("r.block") / BLOCKS_PER_UNIT).cast("int")
    as_node = F.transform(F.sequence(F.lit(0), group), lambda g: F.struct(unit(F.col("r.block"), g).alias("unit"), (g == group).alias("own"), F.lit(False).alias("query")))
    as_query = F.when(F.col("r.block") + 1 < F.col("r.blocks"), F.transform(F.sequence(F.col("r.block") + 1, F.col("r.blocks") - 1), lambda b: F.struct(unit(b, group).alias("unit"), (group == F.floor(b / BLOCKS_PER_UNIT)).alias("own"), F.lit(True).alias("query"))))
    rows = rows.select(F.col("r.t").alias("t"), F.col("r.key").alias("key"), F.explode(F.concat(as_node, F.coalesce(as_query, F.slice(as_node, 1, 0)))).alias("u"), *body)
    rows = rows.select("t", "key", "u.unit", "u.own", "u.query", *body)
    return rows.repartition(tasks, "t", "key", "unit").sortWithinPartitions("t", "key", "unit", "query", "cls")


def verified_links(docs: DataFrame, light: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", nodes: int = SHARD_NODES) -> DataFrame:
    """(cls, root, links): links of each class found in a shard, and the least class that it is joined to there."""
    spark = docs.sparkSession
    reps = light.dropDuplicates(["cls"])
    routed = reps.select("cls", F.posexplode("keys").alias("t", "key"))
    live = _shared(routed)
    near = shard_rows(reps, live, None, _tasks(spark, live), nodes).mapInArrow(_near_of_shards, NEAR_SCHEMA).distinct().checkpoint()
    live = _shared(near)
    grams = map_text(_keyed(docs, doc_id, text), ["doc_id", "h", "text"], "text", gram_sets, GRAM_SCHEMA)
    return shard_rows(reps, live, grams, _tasks(spark, live), nodes).mapInArrow(_links_of_shards, LINK_SCHEMA)


def _shared(routed: DataFrame) -> DataFrame:
    """Rows (cls, t, key) of shards of two or more members, with their size ``n``."""
    sizes = routed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    return routed.join(sizes, ["t", "key"]).checkpoint()


def _tasks(spark: SparkSession, live: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-live.count() // ROWS_PER_TASK))


# --- union ----------------------------------------------------------------------------------


def connected(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root) for nodes of ``edges`` (a, b) other than the roots; root is the least node of the component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014);
    every step is one shuffle on the node, and lineage is cut by a checkpoint.
    """
    ensure_checkpoint(spark)

    def stats(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        return tuple(r)

    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = stats(cur)
    while before[0]:
        sym = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = small.union(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        after = stats(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", nodes: int = SHARD_NODES) -> tuple[DataFrame, DataFrame]:
    """The signatures, and (doc_id, h, class_id, group_id, links, kept) of every row in a group of two or more."""
    spark = docs.sparkSession
    ensure_checkpoint(spark)
    light = signatures(docs, doc_id, text).checkpoint()
    found = verified_links(docs, light, doc_id, text, nodes).checkpoint()
    roots = connected(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), spark)
    linked = found.groupBy("cls").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    rows = light.select("doc_id", "h", "cls").distinct()
    classes = rows.groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "h")).alias("first")).join(linked, "cls", "left")
    classes = classes.where("n > 1 or links > 0").select("cls", "class_id", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min("first").alias("first"))
    known = classes.drop("first").join(groups, "root")
    out = rows.join(known, "cls").select("doc_id", "h", "class_id", "group_id", "links", (F.struct("doc_id", "h") == F.col("first")).alias("kept"))
    return light, out


def near_duplicates(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", nodes: int = SHARD_NODES) -> DataFrame:
    """(doc_id, group_id, class_id, links, kept) of every document in a group of two or more.

    ``group_id`` and ``class_id`` are the least doc_id of the group and of the documents with the same words; ``links`` counts the
    different texts that reach ``MIN_JACCARD`` with this one; ``kept`` marks the one row of the group that stays.
    """
    return _grouped(docs, doc_id, text, nodes)[1].select("doc_id", "group_id", "class_id", "links", "kept")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a near-duplicate group with its group, its class of equal words, its links and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, and one of rows equal in doc_id and text; rows without id or text stay as they are.

    The text meets the decisions of its rows in one shuffle.
    """
    light, groups = _grouped(docs)
    gone = groups.where("not kept").select(F.col("doc_id").alias("ink_id"), F.col("h").alias("ink_h"), F.lit(True).alias("ink_gone"))
    rows = light.groupBy(F.col("doc_id").alias("ink_id"), F.col("h").alias("ink_h")).agg(F.count("*").alias("ink_n"))
    decided = rows.join(gone, ["ink_id", "ink_h"], "left").where("ink_gone or ink_n > 1").drop("ink_n")
    own = docs.withColumns({"ink_id": F.col("doc_id").cast("bigint"), "ink_h": F.xxhash64(F.col("text").cast("string"))})
    left = own.join(decided.withColumn("ink_seen", F.lit(True)), ["ink_id", "ink_h"], "left").where("ink_gone is null")
    once = left.where("ink_seen").dropDuplicates(["ink_id", "ink_h"])
    return left.where("ink_seen is null").unionByName(once).select(*docs.columns)
