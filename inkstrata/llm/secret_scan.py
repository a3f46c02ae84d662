"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
(Cox 2012): what every match must hold, as ANDs and ORs. Documents are indexed
in segments, as they pass, with posting lists for the trigrams that any query
names; a segment holds whole texts and about one megabyte. Postings are
intersected and united as the query says, and only the candidates are matched
with the expression. Rules without a mandatory trigram scan every text. Nothing
is shuffled, and a segment's index never outlives its task.

Trigrams are bytes in lower case of ASCII. Rules are compiled with ``re.ASCII``.

Defined results: a null or empty text has no secrets, a null ``doc_id`` stays
null; matches of one rule do not overlap, those of different rules may; repeated
rows repeat their matches.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # the parser's public name until Python 3.11 was sre_parse
    from re import _constants as C
    from re import _parser as P
except ImportError:
    import sre_constants as C
    import sre_parse as P

from inkstrata.llm.textvec import map_text, table, utf8_parts

RULES: dict[str, str] = {
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[rs]k_live_[0-9A-Za-z]{16,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "password_assignment": r"(?i:\b(?:password|passwd|pwd)[ \t]*[=:][ \t]*[\"']?[^ \t\r\n\"']{8,})",
    "token_assignment": r"(?i:\b(?:token|secret|api_?key)[ \t]*[=:][ \t]*[\"']?[0-9a-z_-]{20,})",
    "hex_digest_key": r"\b[0-9a-f]{40}\b",
}
#: Sets of strings larger than this are given up for a weaker query.
MAX_STRINGS = 16
SCHEMA = "doc_id bigint, rule string, begin_pos int, end_pos int, secret_hash string"

# --- Boolean trigram queries ----------------------------------------------------------------
# A query is True (anything may match), ("tri", code), ("and", [...]) or ("or", [...]).


def _and(parts: list) -> object:
    flat = []
    for p in parts:
        if p is True:
            continue
        flat += p[1] if p[0] == "and" else [p]
    flat = list({repr(p): p for p in flat}.values())
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts: list) -> object:
    if not parts or any(p is True for p in parts):
        return True
    flat = []
    for p in parts:
        flat += p[1] if p[0] == "or" else [p]
    flat = list({repr(p): p for p in flat}.values())
    return flat[0] if len(flat) == 1 else ("or", flat)


def _trigrams(s: bytes) -> object:
    return _and([("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)])


@dataclass
class _Info:
    """What is known of an expression: all its strings if few, else their beginnings and ends, and a query."""

    exact: set[bytes] | None
    prefix: set[bytes]
    suffix: set[bytes]
    query: object

    def settled(self) -> _Info:
        """Without exact strings, so that they count in the query."""
        if self.exact is None:
            return self
        return _Info(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, _and([self.query, _or([_trigrams(s) for s in self.exact])]))


_ANY = lambda: _Info(None, {b""}, {b""}, True)
_EMPTY = lambda: _Info({b""}, {b""}, {b""}, True)


def _strings(chars: set[int]) -> _Info:
    """One character of a set; case is folded for ASCII."""
    if len(chars) > MAX_STRINGS * 2:
        return _ANY()
    s = {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in chars}
    return _Info(s, s, s, True) if s and len(s) <= MAX_STRINGS else _ANY()


def _concat(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MAX_STRINGS:
        both = {a + b for a, b in product(x.exact, y.exact)}
        return _Info(both, both, both, _and([x.query, y.query]))
    end = x.exact if x.exact is not None else x.suffix
    begin = y.exact if y.exact is not None else y.prefix
    # strings that span the joint
    across: object = True
    if len(end) * len(begin) <= MAX_STRINGS * MAX_STRINGS:
        across = _or([_trigrams(a + b) for a, b in product(end, begin)])
    sx, sy = x.settled(), y.settled()
    prefix, suffix = sx.prefix, sy.suffix
    if x.exact is not None and len(x.exact) * len(begin) <= MAX_STRINGS * 4:
        prefix = {(a + b)[:2] for a, b in product(x.exact, begin)}
    if y.exact is not None and len(y.exact) * len(end) <= MAX_STRINGS * 4:
        suffix = {(a + b)[-2:] for a, b in product(end, y.exact)}
    return _Info(None, prefix, suffix, _and([sx.query, sy.query, across]))


def _either(infos: list[_Info]) -> _Info:
    exact = set().union(*[i.exact for i in infos]) if all(i.exact is not None for i in infos) else None
    if exact is not None and len(exact) <= MAX_STRINGS and all(i.query is True for i in infos):
        return _Info(exact, exact, exact, True)
    s = [i.settled() for i in infos]
    return _Info(None, set().union(*[i.prefix for i in s]), set().union(*[i.suffix for i in s]), _or([i.query for i in s]))


def _charset(items: list, ignore_case: bool) -> set[int] | None:
    out: set[int] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            if arg[1] - arg[0] > 4 * MAX_STRINGS:
                return None
            out.update(range(arg[0], arg[1] + 1))
        else:
            return None
    return out


def _analyse(items, flags: int) -> _Info:
    out = _EMPTY()
    for op, arg in items:
        if op is C.LITERAL:
            info = _strings({arg})
        elif op is C.IN:
            chars = None if arg and arg[0][0] is C.NEGATE else _charset(arg, bool(flags & re.I))
            info = _ANY() if chars is None else _strings(chars)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            info = _EMPTY()
        elif op is C.SUBPATTERN:
            info = _analyse(arg[3], flags | arg[1])
        elif op is C.ATOMIC_GROUP:
            info = _analyse(arg, flags)
        elif op is C.BRANCH:
            info = _either([_analyse(b, flags) for b in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, what = arg
            one = _analyse(what, flags)
            if least == 0:
                info = _either([one, _EMPTY()]) if most == 1 else _ANY()
            else:
                info = one
                for _ in range(min(least, 4) - 1):
                    info = _concat(info, one)
                if most != least or least > 4:
                    s = info.settled()
                    tail = one.settled().suffix if least > 4 or most != least else s.suffix
                    info = _Info(None, s.prefix, tail if least <= 4 and len(tail) <= MAX_STRINGS else {b""}, s.query)
        else:  # any character, back references, conditions
            info = _ANY()
        out = _concat(out, info)
    return out


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match satisfies; True if there is none."""
    parsed = P.parse(pattern, re.ASCII)
    return _analyse(parsed, parsed.state.flags).settled().query


def _codes(query: object) -> set[int]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*[_codes(q) for q in query[1]])


# --- segments -------------------------------------------------------------------------------


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.rules = {name: (re.compile(p, re.ASCII), trigram_query(p)) for name, p in rules.items()}
        codes = sorted(set().union(*[_codes(q) for _, q in self.rules.values()])) if rules else []
        self.slot = {c: i for i, c in enumerate(codes)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)  # 0: no query names it
        self.table[codes] = np.arange(1, len(codes) + 1)

    def postings(self, text: pa.Array) -> np.ndarray:
        """The segment's inverted index: for each trigram of the queries, which rows hold it."""
        off, flat = utf8_parts(text)
        hits = np.zeros((len(self.slot), len(text)), dtype=bool)
        if len(flat) < 3 or not self.slot:
            return hits
        low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint32)
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[row + 1]  # not across two texts
        hits[found[at[inside]].astype(np.int64) - 1, row[inside]] = True
        return hits

    def candidates(self, query: object, hits: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(hits.shape[1], bool)
        if query[0] == "tri":
            return hits[self.slot[query[1]]]
        parts = [self.candidates(q, hits) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
        text = text.fill_null("")
        hits = self.postings(text)
        found: list[tuple] = []
        for name, (pattern, query) in self.rules.items():
            rows = np.flatnonzero(self.candidates(query, hits))
            for i, t in zip(rows, text.take(pa.array(rows)).to_pylist()):
                found += [(i, name, m.start(), m.end(), hashlib.sha256(m.group().encode()).hexdigest()[:16]) for m in pattern.finditer(t)]
        row, name, start, end, digest = zip(*found) if found else ((),) * 5
        return pa.record_batch([ids.take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.string())], names=["doc_id", "rule", "begin_pos", "end_pos", "secret_hash"])


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(rules: dict[str, str]) -> Scanner:
    key = tuple(rules.items())
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(rules)
    return _SCANNERS[key]


def secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Every match of every rule: its character offsets and a hash of the secret, never the secret."""
    for name, pattern in rules.items():
        if re.compile(pattern, re.ASCII).match(""):
            raise ValueError(f"rule {name} matches the empty string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(rows, ["doc_id", "text"], "text", lambda b: scanner(rules).scan(b.column(0), b.column(1)), SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Matches and the pieces between them, by the same expressions in RE2; offsets are running lengths."""
    one = " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS rule, regexp_extract_all(text, '{q}') AS m, string_split_regex(text, '{q}') AS p FROM documents WHERE regexp_matches(text, '{q}')"
        for n, q in ((n, p.replace("'", "''")) for n, p in RULES.items())
    )
    return f"""
WITH found AS ({one}),
placed AS (SELECT doc_id, rule, m, p, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, rule, m[i] AS secret,
  length(array_to_string(p[1:i], '')) + coalesce(length(array_to_string(m[1:i-1], '')), 0) AS b FROM placed)
SELECT doc_id, rule, CAST(b AS INTEGER) AS begin_pos, CAST(b + length(secret) AS INTEGER) AS end_pos, left(sha256(secret), 16) AS secret_hash FROM spans"""


ORACLE = _oracle()
