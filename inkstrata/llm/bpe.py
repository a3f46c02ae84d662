"""Byte-pair vocabularies: loading, exact merging and the check of adjacent tokens.

Greedy cuts and exact merging exist for one word and for many at once; both give
the same tokens.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: Folder of the public vocabulary files, and the one used unless another is named.
TOKENIZER_DIR = os.environ.get("INKSTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: How a text falls into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker before its cache starts anew.
CACHE_WORDS = 400_000
#: Bytes of a word up to which it is cut or merged together with others; longer words take their turn one by one.
BULK_BYTES = 64
#: Rank of a pair that never merges.
_NONE = 1 << 40
#: Turn of a pair that never merges, among many words.
_NEVER = 1 << 62


class Lookup:
    """Numbers of distinct keys from 0 on, looked up many at once; -1 for a key that is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.values[slot[here]] = values[here]
            keys, values, slot = keys[~here], values[~here], slot[~here] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], -1)
        more = np.flatnonzero(~hit & (found >= 0))
        while len(more):
            slot[more] = at = slot[more] + 1 & self.mask
            found = self.keys[at]
            hit = found == keys[more]
            out[more[hit]] = self.values[at[hit]]
            more = more[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Ranks of byte strings; the rank is the token's number. A file that lacks one of the 256 bytes is an error."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        lacking = [b for b in range(256) if bytes([b]) not in self.ranks]
        if lacking:
            raise ValueError(f"{path} has no token for the bytes {lacking}")
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.words = regex.compile(WORD_PATTERN).findall
        self._pairs: tuple[np.ndarray, ...] | None = None
        self._bytes: tuple[np.ndarray, np.ndarray] | None = None
        self._longest: dict[bytes, int] | None = None
        self._trie: tuple[Lookup, np.ndarray] | None = None
        self._joins: Lookup | None = None

    def merge(self, word: bytes, below: int | None = None) -> list[bytes]:
        """Exact merging: the pieces of ``word``, using only merges of ranks less than ``below``."""
        after, _ = self._merged(word, _NONE if below is None else below)
        out, i = [], 0
        while i < len(word):
            out.append(word[i : after[i]])
            i = after[i]
        return out

    def count(self, word: bytes) -> int:
        """Number of tokens: initial symbols less merges. No token number is looked up or made."""
        return len(word) - self._merged(word, _NONE)[1]

    def _merged(self, word: bytes, below: int) -> tuple[list[int], int]:
        """Heap of adjacent pairs over a linked list of symbols; the lowest rank merges first, then the leftmost.

        ``pair[i]`` is the rank of the pair that begins at byte ``i``; a popped
        entry that differs from it is out of date. Returns where each symbol
        ends and the number of merges.
        """
        n, get = len(word), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pair = [get(word[i : i + 2], _NONE) for i in range(n - 1)]
        pair.append(_NONE)
        heap = [r * n + i for i, r in enumerate(pair) if r < below]
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            r, i = divmod(pop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = _NONE
            merges += 1
            if k < n:
                before[k] = i
                r = pair[i] = get(word[i : after[k]], _NONE)
                if r < below:
                    push(heap, r * n + i)
            else:
                pair[i] = _NONE
            h = before[i]
            if h >= 0:
                r = pair[h] = get(word[h:k], _NONE)
                if r < below:
                    push(heap, r * n + h)
        return after, merges

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of every word: their tokens one after another, and the number of each."""
        return _in_bulk(words, self._merge_bulk, lambda w: [self.ranks[p] for p in self.merge(w)])

    def joins(self) -> Lookup:
        """The rank of the bytes of two tokens, for every two whose bytes are a token; the key is left * size + right."""
        if self._joins is None:
            get, keys, to = self.ranks.get, [], []
            for t, r in self.ranks.items():
                for k in range(1, len(t)):
                    a, b = get(t[:k]), get(t[k:])
                    if a is not None and b is not None:
                        keys.append(a * self.size + b)
                        to.append(r)
            self._joins = Lookup(np.array(keys, np.int64), np.array(to, np.int64))
        return self._joins

    def _turns(self, token: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place in one number for the pairs of the symbols ``at`` and the next ones, in the order in which they merge; ``_NEVER`` for those that don't."""
        rank = self.joins().get(token[at] * self.size + token[at + 1])
        return np.where(rank < 0, _NEVER, rank << 32 | at)

    def _merge_bulk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each round the leftmost pair of the lowest rank merges in every word; words without any leave."""
        size = np.zeros(len(off) - 1, np.int64)
        word = np.repeat(np.arange(len(size)), np.diff(off))
        token = np.array([self.ranks[bytes([b])] for b in range(256)])[data]
        turn = np.full(len(token), _NEVER)  # of a symbol and the next one
        at = np.flatnonzero(word[1:] == word[:-1])
        turn[at] = self._turns(token, at)
        done, order = [], []
        while len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            number = np.diff(np.append(first, len(word)))
            next_ = np.minimum.reduceat(turn, first)
            live = next_ < _NEVER
            keep = np.repeat(live, number)
            done.append(token[~keep])
            order.append(word[first[~live]])
            size[order[-1]] = number[~live]
            at, rank = next_[live] & (1 << 32) - 1, next_[live] >> 32
            token[at] = rank
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            word, token, turn = word[keep], token[keep], turn[keep]
            turn = np.where(turn < _NEVER, turn >> 32 << 32 | np.arange(len(turn)), turn)
            near = np.concatenate([at, at - 1])
            near = near[(near >= 0) & (near + 1 < len(word))]
            same = word[near] == word[near + 1]
            turn[near[~same]] = _NEVER
            turn[near[same]] = self._turns(token, near[same])
            turn[-1:] = _NEVER
        return _in_order(done, order, size)

    # --- speculation ------------------------------------------------------------------------

    def greedy(self, word: bytes) -> list[int]:
        """Longest matches from the left; every byte has a token of its own."""
        if self._longest is None:
            longest: dict[bytes, int] = {}
            for t in self.ranks:
                if len(t) > 1:
                    longest[t[:2]] = max(longest.get(t[:2], 0), len(t))
            self._longest = longest
        ranks, longest, n = self.ranks, self._longest, len(word)
        out, i = [], 0
        while i < n:
            size = min(longest.get(word[i : i + 2], 1), n - i)
            while (r := ranks.get(word[i : i + size])) is None:
                size -= 1
            out.append(r)
            i += size
        return out

    def greedy_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches in every word: their tokens one after another, and the number of each."""
        return _in_bulk(words, self._greedy_bulk, self.greedy)

    def trie(self) -> tuple[Lookup, np.ndarray]:
        """The node after each node * 256 + byte, and the token that ends at each node, -1 where none does; the root is 0."""
        if self._trie is None:
            nodes, keys, token = {b"": 0}, [], [-1]
            for t, r in self.ranks.items():
                at = 0
                for k in range(1, len(t) + 1):
                    to = nodes.setdefault(t[:k], len(token))
                    if to == len(token):
                        keys.append(at * 256 + t[k - 1])
                        token.append(-1)
                    at = to
                token[at] = r
            self._trie = (Lookup(np.array(keys, np.int64), np.arange(1, len(token))), np.array(token, np.int64))
        return self._trie

    def _greedy_bulk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words walk the trie, a byte a step; where one can't go on, its longest token so far is cut off."""
        (after, ends), size = self.trie(), np.zeros(len(off) - 1, np.int64)
        data = np.append(data, 0)
        live, at, stop = np.arange(len(size)), off[:-1].copy(), off[1:]
        node, best, cut = np.zeros(len(size), np.int64), np.full(len(size), -1), at.copy()
        done, order, place = [], [], []
        while len(live):
            to = np.where(at < stop, after.get(node * 256 + data[at]), -1)
            out = np.flatnonzero((to < 0) & (best >= 0))
            done.append(best[out])
            order.append(live[out])
            place.append(size[live[out]])
            size[live[out]] += 1
            node, at = np.where(to < 0, 0, to), np.where(to < 0, cut, at + 1)
            best = np.where(to < 0, -1, np.where(ends[node] >= 0, ends[node], best))
            cut = np.where(best == ends[node], at, cut)
            on = (to >= 0) | (cut < stop)
            if not on.all():
                live, at, stop, node, best, cut = live[on], at[on], stop[on], node[on], best[on], cut[on]
        flat = np.zeros(size.sum(), np.int64)
        if len(flat):
            flat[(np.cumsum(size) - size)[np.concatenate(order)] + np.concatenate(place)] = np.concatenate(done)
        return flat, size

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Sorted pairs with the token they merge to, and the two parts of each token (itself for a byte)."""
        if self._pairs is None:
            left, right = np.arange(self.size), np.arange(self.size)
            keys, to = [], []
            for t, r in self.ranks.items():
                if len(t) < 2:
                    continue
                parts = self.merge(t, r)
                if len(parts) == 2:
                    a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                    left[r], right[r] = a, b
                    keys.append(a * self.size + b)
                    to.append(r)
            order = np.argsort(keys)
            self._pairs = (np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order], left, right)
        return self._pairs

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair gives just that pair.

        The merges that made both tokens are undone at their common edge, the
        latest first; if at any point the edge symbols could have merged before
        the merge just undone, the pair doesn't occur in an encoding.
        """
        keys, to, left, right = self._tables()
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), self.size + 1, dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            k = x * self.size + y
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            early = (keys[at] == k) & (to[at] < lim)
            good[live[early]] = False
            live, x, y = live[~early], x[~early], y[~early]
            x_part, y_part = right[x], left[y]
            undo_x = ((x > y) & (x_part != x)) | ((x <= y) & (y_part == y))
            end = (x_part == x) & (y_part == y)
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, x_part, x)
            b[live] = np.where(undo_x, y, y_part)
            live = live[~end]
        return good

    # --- decoding ---------------------------------------------------------------------------

    def byte_table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._bytes is None:
            size = np.array([len(t) for t in self.tokens])
            self._bytes = (np.frombuffer(b"".join(self.tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]))
        return self._bytes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens one after another, and where each token ends."""
        flat, off = self.byte_table()
        return flat[ranges(off[ids], off[ids + 1] - off[ids])], np.cumsum(off[ids + 1] - off[ids])


def _in_bulk(words: list[bytes], many: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], one: Callable[[bytes], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their numbers by ``many`` for words of up to ``BULK_BYTES`` bytes, by ``one`` for each longer word."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    long = np.flatnonzero(length > BULK_BYTES)
    short = np.flatnonzero(length <= BULK_BYTES)
    few = words if not len(long) else [words[k] for k in short.tolist()]
    flat, number = many(np.frombuffer(b"".join(few), np.uint8), np.concatenate([[0], np.cumsum(length[short])]))
    if not len(long):
        return flat, number
    rest = [one(words[k]) for k in long.tolist()]
    size = np.zeros(len(words), np.int64)
    size[short], size[long] = number, list(map(len, rest))
    return _in_order([flat, *(np.array(x, np.int64) for x in rest)], [short, long], size)


def _in_order(parts: list[np.ndarray], order: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of ``parts``, which are those of the words ``order``, by word; and ``size``, the number of each word's."""
    if not parts:
        return np.zeros(0, np.int64), size
    by, start = np.concatenate(order), np.zeros(len(size), np.int64)
    start[by] = np.cumsum(size[by]) - size[by]
    return np.concatenate(parts)[ranges(start, size)], size


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + count[i] - 1, one range after another."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of ``path``, read once by each worker."""
    return Vocabulary(path)
