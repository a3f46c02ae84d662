"""Personal data by a semi-Markov conditional random field.

The field labels segments, not tokens: an entity of one of ``KINDS`` is a span
of up to ``MAX_TOKENS`` tokens that is scored as a whole (its shape, length,
numbers of digits and dots, check digit, octets, neighbours), everything else is
a token of its own. Bounded-entity dynamic programming over all segments that
may end at each token, with label transitions, chooses boundaries and kinds
together. Weights are the maximum of the likelihood by forward-backward over
segments; training texts are generated here from grammars of each kind among
look-alikes (versions, dates, keys, order numbers).

An entity has an ``@`` or at least four digits, so the field runs on *islands*:
runs of chunks with a digit or ``@``, parted by at most ``MAX_BLANK`` white space
characters of any kind and at most one chunk without (``MAX_COLD`` bytes: a bank
code, a lone dash) between two of them. An entity with more than that inside is
outside the model. Islands may be of any length.

The field is fitted on ``TRAIN_TEXTS`` generated texts; islands of over
``TRAIN_TOKENS`` tokens are left out of training only. Decoding skips only
segments that cannot be on the best path.

Defined results: null and empty texts have no entities; entities never overlap;
repeated rows repeat; of equal paths the one with the earlier, longer and first
kind wins; offsets count characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstrata.llm.textvec import map_text, table, utf8_parts

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
MAX_TOKENS, MAX_GAPS = 20, 10
#: White space characters between two chunks of an island, and bytes of a chunk without digits inside it.
MAX_BLANK, MAX_COLD = 2, 4
FEATURES = 1 << 16
TRAIN_TEXTS, TRAIN_TOKENS = 2600, 60
#: Tokens whose segments are scored at once; the path does not depend on it.
BLOCK = 512
SCHEMA = "doc_id bigint, kind string, begin_pos int, end_pos int, score double"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_DIGITS = re.compile("[0-9]")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|\s+")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[^:]*:){2,7}[^:]*$)(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HOT = np.zeros(256, dtype=bool)
_HOT[[*range(48, 58), 64]] = True

# --- islands and segments -------------------------------------------------------------------


def islands(text: pa.Array) -> list[tuple[int, int, int]]:
    """(row, first character, end character) of every run of chunks with a digit or ``@`` and what may part them."""
    off, b = utf8_parts(text)
    if not len(b) or not _HOT[b].any():
        return []
    ink = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[1:-1] = ink[1:] != ink[:-1]
    cuts = off[(off > 0) & (off < len(b))]
    edge[cuts] = True
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    start, stop = at[:-1], at[1:]
    hot = np.add.reduceat(_HOT[b].astype(np.int32), start) > 0
    chunk = ink[start]
    start, stop, hot = start[chunk], stop[chunk], hot[chunk]
    near = np.append(start[1:] - stop[:-1] <= MAX_BLANK, False)  # to the next chunk
    short = stop - start <= MAX_COLD
    h = np.flatnonzero(hot)
    row = np.searchsorted(off, start[h], side="right") - 1
    step, a = np.diff(h), h[:-1]
    mid = np.minimum(a + 1, len(start) - 1)
    joined = (row[1:] == row[:-1]) & near[a] & ((step == 1) | (step == 2) & short[mid] & near[mid])
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.append(first[1:] - 1, len(h) - 1)
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    base = chars[off[row[first]]]
    return list(zip(row[first].tolist(), (chars[start[h[first]]] - base).tolist(), (chars[stop[h[last]]] - base).tolist()))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _shape(s: str, exact: bool) -> str:
    def one(m: re.Match) -> str:
        g = m.group()
        if g[0].isspace():
            return " "
        kind = "9" if "0" <= g[0] <= "9" else "a" if g.islower() else "A"
        return kind + (str(min(len(g), 20)) if exact else "")

    return _RUN.sub(one, s)


def _hash(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & (FEATURES - 1)


@lru_cache(maxsize=200_000)
def _slot(s: str) -> int:
    return _hash(s)


N_FEATURES = 14


def span_features(text: str, begin: int, end: int, tokens: int, left: int, right: int) -> list[int]:
    """Features of a whole segment; ``left``/``right`` bound the island."""
    s = text[begin:end]
    digits = "".join(_DIGITS.findall(s))
    n = len(digits)
    before = text[begin - 1] if begin > left else " "
    after = text[end] if end < right else " "
    b = " " if before.isspace() else "w" if before.isalnum() else before
    a = " " if after.isspace() else "w" if after.isalnum() else after
    if a in ".,;:!?)" and (end + 1 >= right or text[end + 1].isspace()):
        a = "stop"
    loose = _shape(s, False)
    parts = s.split(".")
    octets = len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    six = ":" in s and _SIX.fullmatch(s) is not None
    at = s.count("@")
    mail = at == 1 and 0 < s.index("@") < len(s) - 3 and "." in s[s.index("@") :] and " " not in s and "/" not in s
    tail = re.search(r"\.([A-Za-z]{2,6})$", s)
    check = 13 <= n <= 19 and _luhn(digits)
    word = re.search(r"([^\W\d_]+)\W*$", text[max(left, begin - 16) : begin])
    simple = re.sub(r"(?:[aA9]+[._-]?)+", "x", loose)
    return [
        _slot(x)
        for x in (
            "bias", f"s{_shape(s, True)}", f"l{loose}", f"d{min(n, 30)}", f"t{tokens}|{at}", f"@{mail}|{simple}|{bool(tail)}", f"o{octets}{six}" if six else f"o{octets}|{n}",
            f"c{check}|{n}|{loose}", f"b{b}|{s[0] if not s[0].isalnum() else 'w'}", f"a{a}", f"ba{b}|{a}|{mail}|{octets}|{check}|{six}", f"p{word.group(1).lower() if word else ''}",
            f"x{mail}{octets}{check}{six}|{b == ' ' or b in '(<'}|{a in (' ', 'stop')}", f"z{loose[:6]}|{n}|{b == ' '}|{a in (' ', 'stop')}",
        )
    ]


def tokens(text: str, left: int, right: int) -> tuple[list[tuple[int, int]], list[int], list[int], list[int]]:
    """Offsets of an island's tokens, and how many digits, ``@`` and gaps come before each."""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text, left, right)]
    digits = np.cumsum([0, *[len(_DIGITS.findall(text[s:e])) for s, e in spans]]).tolist()
    ats = np.cumsum([0, *[text[s:e] == "@" for s, e in spans]]).tolist()
    gaps = np.cumsum([0, 0, *[spans[i][0] > spans[i - 1][1] for i in range(1, len(spans))]]).tolist()
    return spans, digits, ats, gaps


def ending(text: str, left: int, right: int, token: tuple, first: int, last: int) -> list[tuple[int, int, list[int]]]:
    """Candidate segments (first token, end token, features) that end after tokens ``first`` .. ``last`` - 1."""
    spans, digits, ats, gaps = token
    found = []
    for j in range(first + 1, last + 1):
        c = text[spans[j - 1][0]]
        if not (c.isalnum() or c == "_"):
            continue
        for i in range(j - 1, max(j - MAX_TOKENS, 0) - 1, -1):
            if gaps[j] - gaps[i + 1] > MAX_GAPS:
                break
            if (ats[j] > ats[i] or digits[j] - digits[i] >= 4) and (text[spans[i][0]].isalnum() or text[spans[i][0]] in "+(_"):
                found.append((i, j, span_features(text, spans[i][0], spans[j - 1][1], j - i, left, right)))
    return found


def segments(text: str, left: int, right: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Token offsets of an island and all its candidate segments."""
    token = tokens(text, left, right)
    return token[0], ending(text, left, right, token, 0, len(token[0]))


# --- the field ------------------------------------------------------------------------------


@dataclass
class Model:
    weights: np.ndarray  # FEATURES x kinds
    trans: np.ndarray  # (1 + kinds)^2, from and to; 0 is outside


def viterbi(n: int, blocks: Iterable[tuple[int, list]], model: Model) -> list[tuple[int, int, int, float]]:
    """(first token, end token, kind, score) of the entities on the best path over ``n`` tokens.

    ``blocks``: (tokens so far, segments that end in the block), so that only one
    block's features are held at a time.
    """
    trans = model.trans.tolist()
    states = range(len(KINDS) + 1)
    # what entering a kind, and leaving it, can gain over staying outside
    enter = [max(trans[q][t] - trans[q][0] for q in states) for t in states]
    leave = [max(0.0, *(trans[t][q] - trans[0][q] for q in states)) for t in states]
    value = [[0.0] + [-1e30] * len(KINDS)]
    back: list[list] = [[None] * len(states)]
    for stop, found in blocks:
        score = model.weights[np.array([f for _, _, f in found])].sum(1).tolist() if found else []
        k = 0
        for j in range(len(value), stop + 1):
            prev = value[j - 1]
            p = max(states, key=lambda q: prev[q] + trans[q][0])
            own, steps = [prev[p] + trans[p][0]] + [-1e30] * len(KINDS), [(j - 1, p, 0.0)] + [None] * len(KINDS)
            while k < len(found) and found[k][1] == j:
                i = found[k][0]
                least = (j - i - 1) * trans[0][0]
                for t, s in enumerate(score[k], 1):
                    if enter[t] + s + leave[t] < least:  # the same tokens outside are better whatever comes next
                        continue
                    p = max(states, key=lambda q: value[i][q] + trans[q][t])
                    v = value[i][p] + trans[p][t] + s
                    if v > own[t]:
                        own[t], steps[t] = v, (i, p, s)
                k += 1
            value.append(own), back.append(steps)
    out, j, t = [], n, max(states, key=lambda q: value[n][q])
    while j > 0:
        i, p, s = back[j][t]
        if t:
            out.append((i, j, t - 1, s))
        j, t = i, p
    return out[::-1]


def best_path(n: int, found: list[tuple[int, int, list[int]]], model: Model) -> list[tuple[int, int, int, float]]:
    return viterbi(n, [(n, found)], model) if found else []


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def marginals(seg: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z, marginals of segments and expected transitions.

    ``seg[b, j, l - 1, t]``: score of the segment of ``l`` tokens that ends before token ``j``; -inf if there is none.
    """
    batch, top, longest, kinds = seg.shape
    n = top - 1
    alpha = np.full((batch, n + 1, kinds + 1), -np.inf)
    alpha[:, 0, 0] = 0.0
    enter = np.full((batch, n + 1, kinds + 1), -np.inf)  # alpha and the transition
    enter[:, 0] = _lse(alpha[:, 0, :, None] + trans[None], 1)
    for j in range(1, n + 1):
        l = min(longest, j)
        alpha[:, j, 0] = enter[:, j - 1, 0]
        alpha[:, j, 1:] = _lse(enter[:, j - l : j, 1:][:, ::-1] + seg[:, j, :l], 1)
        enter[:, j] = _lse(alpha[:, j, :, None] + trans[None], 1)
    who = np.arange(batch)
    logz = _lse(alpha[who, size], 1)
    beta = np.full((batch, n + 1, kinds + 1), -np.inf)
    ahead = np.full((batch, n + 1, kinds + 1), -np.inf)  # from token i on, a segment of the state first
    for i in range(n, -1, -1):
        if i < n:
            l = min(longest, n - i)
            steps = np.arange(1, l + 1)
            ahead[:, i, 0] = beta[:, i + 1, 0]
            ahead[:, i, 1:] = _lse(seg[:, i + steps, steps - 1] + beta[:, i + 1 : i + l + 1, 1:], 1)
            beta[:, i] = _lse(trans[None] + ahead[:, i, None, :], 2)
        beta[size == i, i] = 0.0
        ahead[size == i, i] = -np.inf
    mass = np.zeros_like(seg)
    for l in range(1, min(longest, n) + 1):
        mass[:, l:, l - 1] = np.exp(enter[:, : n + 1 - l, 1:] + seg[:, l:, l - 1] + beta[:, l:, 1:] - logz[:, None, None])
    flow = np.exp(alpha[:, :, :, None] + trans + ahead[:, :, None, :] - logz[:, None, None, None])
    return logz, mass, flow.sum((0, 1))


def fit(texts: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 9, l2: float = 2e-5, seed: int = 1) -> Model:
    """Maximum likelihood by Adam over batches of islands; ``texts`` have (begin, end, kind) entities."""
    data = []
    for text, entities in texts:
        gold_at = {(b, e): KINDS.index(k) for b, e, k in entities}
        for _, left, right in islands(pa.array([text])):
            spans, found = segments(text, left, right)
            if not found or len(spans) > TRAIN_TOKENS:
                continue
            gold = [k for k, (i, j, _) in enumerate(found) if (spans[i][0], spans[j - 1][1]) in gold_at]
            data.append((len(spans), found, [(k, gold_at[(spans[found[k][0]][0], spans[found[k][1] - 1][1])]) for k in gold]))
    rng = np.random.default_rng(seed)
    kinds = len(KINDS)
    w, trans = np.zeros((FEATURES, kinds)), np.zeros((kinds + 1, kinds + 1))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for a in range(0, len(order), 128):
            part = [data[i] for i in order[a : a + 128]]
            n = max(x[0] for x in part)
            size = np.array([x[0] for x in part])
            at = np.array([(b, j, j - i - 1) for b, x in enumerate(part) for i, j, _ in x[1]])
            feat = np.array([f for x in part for _, _, f in x[1]])
            seg = np.full((len(part), n + 1, MAX_TOKENS, kinds), -np.inf)
            seg[at[:, 0], at[:, 1], at[:, 2]] = w[feat].sum(1)
            _, mass, flow = marginals(seg, size, trans)
            delta = -mass[at[:, 0], at[:, 1], at[:, 2]]
            observed = np.zeros_like(trans)
            base = 0
            for length, found, gold in part:
                path, j = {}, 0
                for k, t in gold:
                    delta[base + k, t] += 1
                    path[found[k][0]] = (found[k][1], t + 1)
                prev = 0
                while j < length:
                    j, t = path.get(j, (j + 1, 0))
                    observed[prev, t] += 1
                    prev = t
                base += len(found)
            gw = np.zeros_like(w)
            for t in range(kinds):
                gw[:, t] = np.bincount(feat.ravel(), weights=np.repeat(delta[:, t], feat.shape[1]), minlength=FEATURES)
            gw, gt = gw / len(part) - l2 * w, (observed - flow) / len(part)
            step += 1
            for x, m, v, g in ((w, mw, vw, gw), (trans, mt, vt, gt)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(w, trans)


# --- training texts -------------------------------------------------------------------------


def _digits(r: Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _letters(r: Random, a: int, z: int, pool: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return "".join(r.choice(pool) for _ in range(r.randint(a, z)))


def _card(r: Random, good: bool = True) -> str:
    body = r.choice("3456") + _digits(r, r.choice([14, 14, 14, 13]))
    for c in "0123456789":
        if _luhn(body + c) == good:
            n = body + c
            break
    sep = r.choice(["", "", "", " ", "-"])
    return sep.join(n[i : i + 4] for i in range(0, len(n), 4)) if sep and len(n) == 16 else n


def make_entity(r: Random, kind: str) -> str:
    d = lambda n: _digits(r, n)
    if kind == "EMAIL":
        user = r.choice([lambda: _letters(r, 2, 10), lambda: _letters(r, 2, 8) + "." + d(2), lambda: _letters(r, 2, 8) + "." + _letters(r, 2, 8), lambda: _letters(r, 1, 6) + r.choice("_-+") + _letters(r, 1, 6), lambda: _letters(r, 3, 7) + d(r.randint(1, 4))])()
        host = r.choice([lambda: _letters(r, 3, 9), lambda: _letters(r, 3, 5) + d(1) + "." + _letters(r, 4, 8), lambda: _letters(r, 3, 7) + "-" + _letters(r, 2, 5), lambda: _letters(r, 2, 6) + "." + _letters(r, 3, 8)])()
        out = f"{user}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'edu', 'info'])}"
        return out.upper() if r.random() < 0.05 else out
    if kind == "PHONE":
        a, b, c = str(r.randint(2, 9)) + d(2), d(3), d(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"+{r.randint(20, 99)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{r.randint(20, 99)}{d(10)}", f"1-{a}-{b}-{c}", f"{a} - {b} - {c}"])
    if kind == "IP":
        if r.random() < 0.3:
            part = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(2, 4)))
            if r.random() < 0.6:
                s = r.choice(["2001:db8::", "fe80::", "fe80::", "2a01:4f8::", part() + "::", part() + ":" + part() + "::"]) + ":".join(part() for _ in range(r.randint(1, 5)))
                return s if len(_DIGITS.findall(s)) >= 4 else "2001:db8::1"
            return ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))
        return ".".join(str(r.randint(1 if i == 0 else 0, 255)) for i in range(4))
    if kind == "CARD":
        return _card(r)
    if kind == "SSN":
        return f"{r.randint(1, 899):03d}-{d(2)}-{d(4)}"
    bank = _letters(r, 4, 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    iban = r.choice([
        lambda: r.choice(["DE", "FR", "ES", "IT", "PL"]) + d(2) + d(r.choice([14, 18, 20, 24])), lambda: "GB" + d(2) + bank + d(14), lambda: "NL" + d(2) + bank + d(10), lambda: "IE" + d(2) + bank + d(14), lambda: "MT" + d(2) + bank + d(23),
    ])()
    return " ".join(iban[i : i + 4] for i in range(0, len(iban), 4)) if r.random() < 0.5 else iban


def _parted(r: Random, s: str) -> str:
    """Now and then with other white space than single blanks."""
    return s.replace(" ", r.choice(["  ", "\t", "\n", "\u00a0"])) if " " in s and r.random() < 0.15 else s


def make_other(r: Random) -> str:
    """Something with digits or ``@`` that is no personal data."""
    d = lambda n: _digits(r, n)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    return r.choice([
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 30)}", lambda: f"v{r.randint(1, 9)}.{d(1)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1990, 2030)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23):02d}:{d(2)}:{d(2)}", lambda: f"${r.randint(1, 999)},{d(3)}.{d(2)}", lambda: str(r.randint(1, 10**r.randint(1, 9))),
        lambda: d(r.choice([10, 12, 14, 15, 17, 18, 20, 24])), lambda: _card(r, False), lambda: hexa(r.choice([16, 18, 32, 40, 64])), lambda: f'token = "{hexa(40)}"', lambda: f"password={hexa(18)}", lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: f"http://{_letters(r, 3, 8)}.example.com/en/{d(4)}?page={d(1)}", lambda: "@" + _letters(r, 3, 9), lambda: f"{_letters(r, 1, 4)} @ {_letters(r, 1, 4)}", lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{d(3)}.{d(1)}", lambda: f"ID-{d(6)}", lambda: f"{d(2)}%", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(4)}-{d(4)}",
        lambda: f"CC BY-NC {r.randint(1, 4)}.0.", lambda: f"version {r.randint(1, 5)}", lambda: f"{_letters(r, 3, 8)}{d(2)}", lambda: f"{d(1)}x{d(2)}", lambda: f"{r.randint(1, 99)} {r.randint(1, 99)} {r.randint(1, 999)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)},{d(2)}", lambda: r.choice(["\t", "\n", "  ", " - "]).join(d(r.randint(1, 4)) for _ in range(r.randint(2, 6))), lambda: f"{r.randint(0, 23):02d}:{d(2)} - {r.randint(0, 23):02d}:{d(2)}", lambda: f"{hexa(2)}:{hexa(2)}:{hexa(2)}:{d(2)}:{hexa(2)}:{d(2)}", lambda: f"{_letters(r, 4, 4).upper()} {d(4)} {d(4)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
    ])()


def training_texts(n: int = TRAIN_TEXTS, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the offsets of their entities, from the grammars above."""
    r, out = Random(seed), []
    cues = {"EMAIL": ["email", "mail", "contact", "at"], "PHONE": ["tel", "phone", "call", "fax"], "IP": ["ip", "host", "from", "address"], "CARD": ["card", "visa", "paid"], "SSN": ["ssn", "social"], "IBAN": ["iban", "account"]}
    for _ in range(n):
        text, entities = "", []
        for _ in range(r.randint(1, 5)):
            if text:
                text += r.choice([" ", " ", " ", " ", "\n", ", ", ". "])
            if r.random() < 0.7:
                text += " ".join(_letters(r, 1, 9) for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.15:
                    text += r.choice(cues[kind]) + r.choice([" ", ": ", ":"])
                text += (opening := r.choice(["", "", "", "", "", "(", "<", '"']))
                s = _parted(r, make_entity(r, kind))
                entities.append((len(text), len(text) + len(s), kind))
                text += s + {"(": ")", "<": ">", '"': '"', "": r.choice(["", "", "", ".", ","])}[opening]
            else:
                text += make_other(r)
        out.append((text, entities))
    return out


_MODEL: list[Model] = []


def trained() -> Model:
    """The field fitted to the generated texts, once for each process."""
    if not _MODEL:
        _MODEL.append(fit(training_texts()))
    return _MODEL[0]


# --- over documents -------------------------------------------------------------------------


def compact(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that training has met, for sending to the workers."""
    used = np.flatnonzero(np.abs(model.weights).sum(1) > 0)
    return used, model.weights[used].astype(np.float32), model.trans


def unpack(used: np.ndarray, rows: np.ndarray, trans: np.ndarray) -> Model:
    w = np.zeros((FEATURES, len(KINDS)), np.float32)
    w[used] = rows
    return Model(w, trans)


def find(text: pa.Array, model: Model) -> list[tuple[int, str, int, int, float]]:
    """(row, kind, begin, end, score) of all entities of an array of texts."""
    text = text.fill_null("")
    spots = islands(text)
    if not spots:
        return []
    rows = sorted({r for r, _, _ in spots})
    whole = dict(zip(rows, text.take(pa.array(rows)).to_pylist()))
    out = []
    for r, left, right in spots:
        token = tokens(whole[r], left, right)
        spans = token[0]
        n = len(spans)
        stops = range(0, n, BLOCK)
        parts = ((min(a + BLOCK, n), ending(whole[r], left, right, token, a, min(a + BLOCK, n))) for a in stops)
        out += [(r, KINDS[t], spans[i][0], spans[j - 1][1], s) for i, j, t, s in viterbi(n, parts, model)]
    return out


def entities(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every entity of every document, its kind and its character offsets."""
    packed = compact(model or trained())
    own: list[Model] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not own:
            own.append(unpack(*packed))
        found = find(batch.column(1), own[0])
        if not found:
            return None
        row, kind, begin, end, score = zip(*found)
        return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(kind), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(np.round(score, 3))], names=["doc_id", "kind", "begin_pos", "end_pos", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(rows, ["doc_id", "text"], "text", run, SCHEMA)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "documents"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each entity becomes its kind in brackets; ``n_chars`` follows the text."""
    packed = compact(trained())
    own: list[Model] = []
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(unpack(*packed))
        by: dict[int, list] = {}
        for r, kind, begin, end, _ in find(batch.column(at), own[0]):
            by.setdefault(r, []).append((begin, end, kind))
        if not by:
            return batch
        texts = batch.column(at).to_pylist()
        for r, found in by.items():
            out, last = [], 0
            for begin, end, kind in found:
                out += [texts[r][last:begin], f"[{kind}]"]
                last = end
            texts[r] = "".join([*out, texts[r][last:]])
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        if count is not None:
            sizes = columns[count].to_pylist()
            for r in by:
                sizes[r] = len(texts[r])
            columns[count] = pa.array(sizes, columns[count].type)
        return pa.record_batch(columns, schema=batch.schema)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return map_text(docs, docs.columns, "text", run, schema)
