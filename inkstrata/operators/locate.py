"""Locating values in the words of a document, exactly or nearly, with the boxes they cover, and evidence from what is found.

A document and all that is sought in it travel together in one row, so that the
word stream is made once for each document. The search is sequential (windows,
early exits, Ratcliff/Obershelp ratios) and runs in Arrow batches. Exact places
come from one substring search over the joined words, not from windows; of the
windows for a near match only those whose letters could reach the ratio are
compared, in vectors over all windows.

Rows of documents have ``doc_id`` and either ``text`` (pages parted by form
feeds, lines as blocks) or ``words``, an array of structs with text, page,
block, x0, y0, x1, y1 and confidence in reading order, and ``page_texts``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.operators.schema import leaf_strings

MIN_RATIO, MIN_QUICK = 0.8, 0.5
#: Words of a line whose gap is at most this share of their height join without a blank.
TIGHT_GAP = 0.3
#: Confidence of a value that is in a page's text but in no block.
PAGE_CONFIDENCE = 0.7
_DROP = str.maketrans("", "", "$€£¥,")
_LETTERS = 64

BOX = pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())])
RECTS = pa.list_(pa.struct([("page", pa.int32()), ("box", BOX)]))
_BOX_SQL = "struct<x0: double, y0: double, x1: double, y1: double>"
_PLACE_SQL = f"page int, pages int, found string, box {_BOX_SQL}, rects array<struct<page: int, box: {_BOX_SQL}>>, blocks array<int>"
WORD_SCHEMA = "array<struct<text: string, page: int, block: int, x0: double, y0: double, x1: double, y1: double, confidence: double>>"
SPAN_SCHEMA = f"doc_id bigint, query string, exact boolean, ratio double, first_word int, last_word int, {_PLACE_SQL}, confidence double"


def normal(s: object, case_sensitive: bool = False) -> str:
    s = str(s).strip()
    return " ".join((s if case_sensitive else s.lower()).translate(_DROP).split())


@dataclass
class Word:
    text: str
    norm: str
    page: int
    block: int
    box: tuple[float, float, float, float] | None = None
    confidence: float | None = None


@dataclass
class Span:
    first: int
    last: int
    exact: bool
    ratio: float


def stream(text: str) -> list[Word]:
    """The words of a plain text; those that normalise to nothing are left out."""
    out = []
    for number, page in enumerate(text.split("\f")):
        for block, line in enumerate(x for x in page.split("\n") if x.strip(" ")):
            out += [Word(w, n, number, block) for w in line.split() if (n := normal(w))]
    return out


def stream_of(words: list[dict], case_sensitive: bool = False) -> list[Word]:
    """The same of words with boxes."""
    out = []
    for w in words:
        if n := normal(w["text"] or "", case_sensitive):
            box = None if w["x0"] is None else (w["x0"], w["y0"], w["x1"], w["y1"])
            out.append(Word(w["text"], n, w["page"], w["block"], box, w["confidence"]))
    return out


def _joints(words: list[Word]) -> list[str]:
    """What parts each word from the next: nothing where they touch on one line."""
    out = []
    for a, b in pairwise(words):
        touch = False
        if a.block == b.block and a.page == b.page and a.box and b.box and a.box != b.box:
            height = max(a.box[3] - a.box[1], b.box[3] - b.box[1])
            touch = height > 0 and b.box[0] - a.box[2] <= height * TIGHT_GAP
        out.append("" if touch else " ")
    return out


class Located:
    """A document's word stream, ready for many searches."""

    def __init__(self, words: list[Word]):
        self.words, self.joint = words, _joints(words)
        self.spaced = self._joined([" "] * len(self.joint))
        self.tight = self._joined(self.joint) if "" in self.joint else None
        self._letters: np.ndarray | None = None
        self._chars: np.ndarray | None = None

    def _joined(self, joint: list[str]) -> tuple[str, np.ndarray]:
        """All words as one string, and where each begins."""
        begin, at, parts = [], 0, []
        for w, sep in zip(self.words, [*joint, ""]):
            begin.append(at)
            parts += [w.norm, sep]
            at += len(w.norm) + len(sep)
        return "".join(parts), np.array(begin, dtype=np.int64)

    def part(self, first: int, end: int, tight: bool = False) -> str:
        joint = self.joint if tight else None
        return "".join(x for k in range(first, end) for x in ((joint[k - 1] if joint else " ") if k > first else "", self.words[k].norm))

    def holds(self, first: int, end: int, query: str) -> bool:
        return query in self.part(first, end) or self.tight is not None and query in self.part(first, end, True)

    def narrow(self, first: int, end: int, query: str) -> tuple[int, int]:
        """The shortest window that still holds the query: trimmed on the left, then on the right."""
        while end - first > 1 and self.holds(first + 1, end, query):
            first += 1
        while end - first > 1 and self.holds(first, end - 1, query):
            end -= 1
        return first, end

    def _next(self, query: str, start: int, longest: int) -> tuple[int, int] | None:
        """First and last word of the occurrence that ends first among those from word ``start`` on of at most ``longest`` words."""
        best = None
        for text, begin in filter(None, (self.spaced, self.tight)):
            at = text.find(query, int(begin[start])) if start < len(begin) else -1
            while at >= 0:
                i = int(np.searchsorted(begin, at, side="right")) - 1
                j = int(np.searchsorted(begin, at + len(query) - 1, side="right")) - 1
                if j - i < longest:
                    if best is None or j < best[1]:
                        best = (i, j)
                    break
                at = text.find(query, at + 1)
        return best

    def exact(self, query: str, stop: Callable[[Span], bool]) -> list[Span]:
        """Spans that hold the query, one after another, until ``stop`` says so."""
        n, total = len(query.split()), len(self.words)
        sizes = [s for s in dict.fromkeys((n, n - 1, min(total, n + 1))) if s > 0]
        found, start = [], 0
        while hit := self._next(query, start, max(sizes)):
            i, j = hit
            end = None
            for s in range(max(start, j + 1 - max(sizes)), i + 1):
                end = next((s + size for size in sizes if s + size <= total and self.holds(s, s + size, query)), None)
                if end is not None:
                    a, b = self.narrow(s, end, query)
                    found.append(Span(a, b - 1, True, 1.0))
                    break
            if end is None:
                start = i + 1
            elif stop(found[-1]):
                break
            else:
                start = end
        return found

    def _counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Running numbers of letters (hashed to ``_LETTERS``) and of characters of the words."""
        if self._letters is None:
            own = np.zeros((len(self.words) + 1, _LETTERS), np.int32)
            for k, w in enumerate(self.words, 1):
                np.add.at(own[k], np.frombuffer(w.norm.encode("utf-32-le"), np.uint32) % _LETTERS, 1)
            self._letters, self._chars = np.cumsum(own, 0, dtype=np.int32), np.cumsum([0, *(len(w.norm) for w in self.words)])
        return self._letters, self._chars

    def near(self, query: str, threshold: float) -> list[Span]:
        """The window most like the query, if it reaches the threshold; of equal ones the earliest."""
        letters, chars = self._counts()
        total, n = len(self.words), len(query.split())
        want = np.bincount(np.frombuffer(query.replace(" ", "").encode("utf-32-le"), np.uint32) % _LETTERS, minlength=_LETTERS)
        some = np.flatnonzero(want)
        tried = []
        for k, size in enumerate((n, n - 1, min(total, n + 1))):
            if size < 1 or size > total or k == 1 and n == 1:
                continue
            both = np.minimum(letters[size:, some] - letters[: total + 1 - size, some], want[some]).sum(1) + min(size - 1, n - 1)
            bound = 2 * both / (chars[size:] - chars[: total + 1 - size] + size - 1 + len(query))
            at = np.flatnonzero(bound >= max(threshold, MIN_QUICK))
            tried += zip(at.tolist(), [k] * len(at), [size] * len(at), bound[at].tolist())
        best: Span | None = None
        for i, _, size, bound in sorted(tried):
            if best is not None and bound <= best.ratio:
                continue
            ratio = SequenceMatcher(None, query, self.part(i, i + size)).ratio()
            if ratio >= threshold and (best is None or ratio > best.ratio):
                best = Span(i, i + size - 1, False, ratio)
        return [best] if best else []

    def locate(self, query: str, every: bool = False, fuzzy: bool = True, threshold: float = MIN_RATIO, hint: int | None = None, case_sensitive: bool = False) -> list[Span]:
        """The best span of a query, or every exact one.

        Windows have as many words as the query, one fewer or one more; an exact
        match is followed from behind it, a match on the hinted page comes before
        others, exact ones before the best near one.
        """
        want = normal(query, case_sensitive)
        if not want or not self.words:
            return []
        found = self.exact(want, lambda s: not every and (hint is None or self.words[s.first].page == hint))
        if found:
            return found if every else [min(found, key=lambda s: (hint is None or self.words[s.first].page != hint, s.first))]
        return self.near(want, threshold) if fuzzy else []

    def place(self, s: Span) -> dict:
        """Page, text, boxes, blocks and least confidence of a span."""
        own = self.words[s.first : s.last + 1]
        rects: list[tuple[int, list]] = []
        last = None
        for w in own:
            if (w.page, w.block) != last:
                rects.append((w.page, []))
                last = (w.page, w.block)
            if w.box:
                rects[-1][1].append(w.box)
        boxes = [{"page": p, "box": _union(b)} for p, b in rects if b]
        pages = {w.page for w in own}
        sure = [w.confidence for w in own if w.confidence is not None]
        return {
            "page": own[0].page, "pages": len(pages), "found": " ".join(w.text for w in own), "box": _union([tuple(r["box"].values()) for r in boxes]) if len(pages) == 1 and boxes else None, "rects": boxes,
            "blocks": list(dict.fromkeys(w.block for w in own)), "confidence": round(min(sure), 4) if sure else None,
        }


def _union(boxes: list[tuple]) -> dict:
    x0, y0, x1, y1 = zip(*boxes)
    return {"x0": min(x0), "y0": min(y0), "x1": max(x1), "y1": max(y1)}


def locate(words: list[Word], query: str, every: bool = False, **options) -> list[Span]:
    return Located(words).locate(query, every, **options)


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, page_texts of rows that may lack some of them."""
    have = set(docs.columns)
    text = F.col("text") if "text" in have else F.lit(None).cast("string")
    return docs.select(
        "doc_id", text.alias("text"), (F.col("words").cast(WORD_SCHEMA) if "words" in have else F.lit(None).cast(WORD_SCHEMA)).alias("words"),
        (F.col("page_texts") if "page_texts" in have else F.split(text, "\\f")).alias("page_texts"),
    )


def _located(text: str | None, words: list[dict] | None, case_sensitive: bool = False) -> Located:
    return Located(stream_of(words, case_sensitive) if words is not None else stream(text or ""))


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_PLACE = [("page", pa.int32()), ("pages", pa.int32()), ("found", pa.string()), ("box", BOX), ("rects", RECTS), ("blocks", pa.list_(pa.int32())), ("confidence", pa.float64())]
_SPANS = pa.schema([("doc_id", pa.int64()), ("query", pa.string()), ("exact", pa.bool_()), ("ratio", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), *_PLACE])


def _search(both: DataFrame, every: bool, fuzzy: bool, threshold: float, case_sensitive: bool) -> DataFrame:
    """``both``: doc_id, text, words, page_texts and queries, an array of structs with query and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc = _located(r["text"], r["words"], case_sensitive)
                for q in r["queries"]:
                    for s in doc.locate(q["query"], every, fuzzy, threshold, q["page"], case_sensitive):
                        out.append({"doc_id": r["doc_id"], "query": q["query"], "exact": s.exact, "ratio": round(s.ratio, 4), "first_word": s.first, "last_word": s.last, **doc.place(s)})
            yield _table(out, _SPANS)

    return both.mapInArrow(run, SPAN_SCHEMA)


def spans(docs: DataFrame, queries: DataFrame, every: bool = False, fuzzy: bool = True, threshold: float = MIN_RATIO, case_sensitive: bool = False) -> DataFrame:
    """Spans of each document's queries. ``queries``: doc_id, query and perhaps hint_page. A query that isn't found gives no row."""
    page = F.col("hint_page").cast("int") if "hint_page" in queries.columns else F.lit(None).cast("int")
    asked = queries.where("query is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("query", page.alias("page")))).alias("queries"))
    return _search(_documents(docs).join(asked, "doc_id"), every, fuzzy, threshold, case_sensitive)


def everywhere(docs: DataFrame, phrases: list[str], every: bool = False, fuzzy: bool = True, threshold: float = MIN_RATIO) -> DataFrame:
    """Spans of each of a list of phrases in every document; the list is part of the plan, so no row is joined."""
    if not fuzzy:
        return _everywhere_exact(docs, phrases, every)
    asked = F.array(*[F.struct(F.lit(p).alias("query"), F.lit(None).cast("int").alias("page")) for p in phrases])
    return _search(_documents(docs).withColumn("queries", asked), every, fuzzy, threshold, False)


def _everywhere_exact(docs: DataFrame, phrases: list[str], every: bool) -> DataFrame:
    """Exact spans of phrases: one automaton finds in one pass which of them a document holds, and only those are located.

    Words that touch are joined without a blank only where they have boxes, so documents with ``words`` are sought phrase by phrase.
    """
    import ahocorasick

    wanted: dict[str, list[str]] = {}
    for p in phrases:
        if n := normal(p):
            wanted.setdefault(n, []).append(p)
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            a = ahocorasick.Automaton()
            for k, n in enumerate(wanted):
                a.add_word(n, (k, n))
            if wanted:
                a.make_automaton()
            held.append(a)
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text, words = batch["text"][k].as_py(), batch["words"][k].as_py()
                if words is None:
                    met = {hit for _, hit in held[0].iter(" ".join((text or "").lower().translate(_DROP).split()))} if wanted else set()
                    some = [n for _, n in sorted(met)]
                else:
                    some = list(wanted)
                doc = _located(text, words) if some else None
                for n in some:
                    for s in doc.locate(n, every, False):
                        place = {"exact": True, "ratio": 1.0, "first_word": s.first, "last_word": s.last, **doc.place(s)}
                        out += [{"doc_id": batch["doc_id"][k].as_py(), "query": p, **place} for p in wanted[n]]
            yield _table(out, _SPANS)

    return _documents(docs).select("doc_id", "text", "words").mapInArrow(run, SPAN_SCHEMA)


def page_hits(docs: DataFrame, phrases: list[str], context: int = 50) -> DataFrame:
    """doc_id, query, page, place (from 0), context: the first plain hit, any case, of each phrase in each page's text.

    All phrases are sought by one automaton in one pass over a page.
    """
    import ahocorasick

    folded = {}
    for p in phrases:
        if p:
            folded.setdefault(p.lower(), []).append(p)
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            a = ahocorasick.Automaton()
            for f in folded:
                a.add_word(f, f)
            if folded:
                a.make_automaton()
            held.append(a)
        for batch in batches:
            out = []
            for doc, pages in zip(*[c.to_pylist() for c in batch.columns]):
                for number, text in enumerate(pages or []):
                    low, first = (text or "").lower(), {}
                    for end, f in held[0].iter(low) if folded else ():
                        first.setdefault(f, end + 1 - len(f))
                    for f, at in first.items():
                        out += [{"doc_id": doc, "query": p, "page": number, "place": at, "context": around(text, at, len(f), context)} for p in folded[f]]
            yield _table(out, pa.schema([("doc_id", pa.int64()), ("query", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("context", pa.string())]))

    return _documents(docs).select("doc_id", "page_texts").mapInArrow(run, "doc_id bigint, query string, page int, place int, context string")


def around(text: str, at: int, size: int, context: int) -> str:
    """A hit with what surrounds it, and dots where that is cut."""
    a, z = max(0, at - context), min(len(text), at + size + context)
    return ("..." if a else "") + text[a:z] + ("..." if z < len(text) else "")


_HITS = pa.schema([("doc_id", pa.int64()), ("query", pa.string()), ("kind", pa.string()), ("ratio", pa.float64()), *_PLACE[:-1], ("context", pa.string())])
HIT_SCHEMA = f"doc_id bigint, query string, kind string, ratio double, {_PLACE_SQL}, context string"


def search_document(docs: DataFrame, phrases: list[str], context: int = 50, fuzzy: bool = False, threshold: float = MIN_RATIO, case_sensitive: bool = False) -> DataFrame:
    """Every exact span of each phrase, else the best near one if ``fuzzy``, and the first plain hit on pages without a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc = _located(r["text"], r["words"], case_sensitive)
                pages = [p or "" for p in r["page_texts"] or []]
                fold = (lambda x: x) if case_sensitive else str.lower
                for q in filter(None, phrases):
                    found = doc.locate(q, True, False, threshold, None, case_sensitive)
                    if not found and fuzzy:
                        found = doc.locate(q, False, True, threshold, None, case_sensitive)
                    met = set()
                    for s in found:
                        p = doc.place(s)
                        met.add(p["page"])
                        p.pop("confidence")
                        page = pages[p["page"]] if p["page"] < len(pages) else ""
                        at = page.lower().find(p["found"].lower())
                        around_it = p["found"] if at < 0 else around(page, at, len(p["found"]), context)
                        out.append({"doc_id": r["doc_id"], "query": q, "kind": "exact" if s.exact else "fuzzy", "ratio": round(s.ratio, 4), **p, "context": around_it})
                    for number, page in enumerate(pages):
                        at = -1 if number in met else fold(page).find(fold(q))
                        if at >= 0:
                            out.append({"doc_id": r["doc_id"], "query": q, "kind": "page_text", "ratio": 1.0, "page": number, "pages": 1, "found": page[at : at + len(q)], "box": None, "rects": [], "blocks": [], "context": around(page, at, len(q), context)})
            yield _table(out, _HITS)

    return _documents(docs).mapInArrow(run, HIT_SCHEMA)


# --- evidence -------------------------------------------------------------------------------

_EVIDENCE = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("seq", pa.int32()), ("value", pa.string()), ("text", pa.string()), ("source", pa.string()), ("ratio", pa.float64()), *_PLACE])
EVIDENCE_SCHEMA = f"doc_id bigint, field string, seq int, value string, text string, source string, ratio double, {_PLACE_SQL}, confidence double"
_NOWHERE = {"pages": 0, "found": None, "box": None, "rects": [], "blocks": [], "ratio": 0.0, "confidence": None}


def attach(doc: Located, pages: list[str], value: str | None, composite: object = None, hint_text: str | None = None, hint_page: int | None = None) -> list[dict]:
    """The evidence of one value.

    Of a composite value each distinct leaf that lies in boxes is evidence of
    its own. Else the hint, then the value, is sought: an exact span, the first
    near one, a page's text, or only the hinted page.
    """
    page = hint_page or 0
    out = []
    if isinstance(composite, (list, dict)):
        for leaf in dict.fromkeys(leaf_strings(composite)):
            found = doc.locate(leaf, hint=page)
            place = doc.place(found[0]) if found else {"rects": []}
            if place["rects"]:
                out.append({"text": leaf, "source": "exact_block" if found[0].exact else "fuzzy_block", "ratio": round(found[0].ratio, 4), **place})
    if out:
        return out
    text = hint_text or value
    if not text:
        return []
    near = None
    for target in dict.fromkeys(t for t in (text, value) if t):
        found = doc.locate(target, hint=page)
        if found and found[0].exact:
            near = found[0]
            break
        near = near or (found[0] if found else None)
    if near:
        return [{"text": text, "source": "exact_block" if near.exact else "fuzzy_block", "ratio": round(near.ratio, 4), **doc.place(near)}]
    want = normal(text)
    for number, body in enumerate(pages):
        if want and want in normal(body or ""):
            return [{**_NOWHERE, "text": text, "source": "page_text", "ratio": 1.0, "page": number, "pages": 1, "confidence": PAGE_CONFIDENCE}]
    return [{**_NOWHERE, "text": text, "source": "unmatched", "page": page}]


def evidence_of(rows: DataFrame) -> DataFrame:
    """Evidence of the fields of each row; nothing is joined.

    ``rows``: documents with ``fields``, an array of structs with field, value and perhaps composite (JSON), hint_text, hint_page.
    """
    inner = {f.name for f in rows.schema["fields"].dataType.elementType.fields}
    ask = lambda n, t: (lambda x: x[n].cast(t) if n in inner else F.lit(None).cast(t))
    parts = (("field", "string"), ("value", "string"), ("composite", "string"), ("hint_text", "string"), ("hint_page", "int"))
    asked = F.transform("fields", lambda x: F.struct(*[ask(n, t)(x).alias(n) for n, t in parts]))
    both = _documents(rows.drop("fields")).columns
    keep = rows.select(*[F.col(c) for c in rows.columns if c in (*both, "text", "words", "page_texts")], asked.alias("asked"))
    packed = _documents(keep.withColumn("asked", F.col("asked"))).columns
    src = keep.select("doc_id", "asked", *[c for c in keep.columns if c in ("text", "words", "page_texts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc = _located(r["text"], r["words"])
                for f in r["asked"] or []:
                    composite = json.loads(f["composite"]) if f["composite"] else None
                    for k, e in enumerate(attach(doc, r["page_texts"] or [], f["value"], composite, f["hint_text"], f["hint_page"])):
                        out.append({"doc_id": r["doc_id"], "field": f["field"], "seq": k, "value": f["value"], **e})
            yield _table(out, _EVIDENCE)

    have = set(src.columns)
    text = F.col("text") if "text" in have else F.lit(None).cast("string")
    full = src.select("doc_id", "asked", text.alias("text"), (F.col("words").cast(WORD_SCHEMA) if "words" in have else F.lit(None).cast(WORD_SCHEMA)).alias("words"), (F.col("page_texts") if "page_texts" in have else F.split(text, "\\f")).alias("page_texts"))
    del packed
    return full.mapInArrow(run, EVIDENCE_SCHEMA)


def evidence(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """The evidence of each field's value. ``fields``: doc_id, field, value and perhaps composite, hint_text, hint_page; fields of an unknown document give none."""
    extra = [c for c in ("composite", "hint_text", "hint_page") if c in fields.columns]
    asked = fields.where(F.col("value").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", *extra))).alias("fields"))
    return evidence_of(docs.select(*[c for c in docs.columns if c in ("doc_id", "text", "words", "page_texts")]).join(asked, "doc_id"))


OCR_SCHEMA = f"doc_id bigint, field string, method string, ratio double, score double, {_PLACE_SQL}"
_OCR = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("method", pa.string()), ("ratio", pa.float64()), ("score", pa.float64()), *_PLACE[:-1]])


def read_score(doc: Located, pages: list[str], page_means: list[float | None], value: str | None, hint_text: str | None = None, hint_page: int | None = None) -> dict:
    """How well OCR read a field: the least confidence of its words, or its page's mean, or nothing."""
    targets = [t for t in dict.fromkeys((hint_text, value)) if t and normal(t)]
    near = None
    for t in targets:
        found = doc.locate(t, hint=hint_page)
        if found and found[0].exact:
            near = found[0]
            break
        near = near or (found[0] if found else None)
    if near:
        place = doc.place(near)
        return {"method": "exact_block" if near.exact else "fuzzy_block", "ratio": round(near.ratio, 4), "score": place.pop("confidence"), **place}
    for t in targets:
        want = normal(t)
        for number, body in enumerate(pages):
            if want in normal(body or ""):
                mean = page_means[number] if number < len(page_means) else None
                return {"method": "page_text", "ratio": 1.0, "score": None if mean is None else round(mean, 4), "page": number, "pages": 1, "found": want, "box": None, "rects": [], "blocks": []}
    return {"method": "unmatched", "ratio": 0.0, "score": None, "page": None, "pages": 0, "found": "", "box": None, "rects": [], "blocks": []}


def field_confidence(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """OCR confidence of each field (doc_id, field, value, perhaps hint_text, hint_page) of documents with ``words``; none for documents without any confidence."""
    extra = [c for c in ("hint_text", "hint_page") if c in fields.columns]
    asked = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", *extra))).alias("asked"))
    both = _documents(docs).join(asked, "doc_id").where(F.exists("words", lambda w: w["confidence"].isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc, pages = _located(None, r["words"]), r["page_texts"] or []
                by: dict[int, list[float]] = {}
                for w in r["words"]:
                    if w["confidence"] is not None:
                        by.setdefault(w["page"], []).append(w["confidence"])
                means = [sum(by[k]) / len(by[k]) if k in by else None for k in range(len(pages))]
                out += [{"doc_id": r["doc_id"], "field": f["field"], **read_score(doc, pages, means, f["value"], f.get("hint_text"), f.get("hint_page"))} for f in r["asked"]]
            yield _table(out, _OCR)

    return both.mapInArrow(run, OCR_SCHEMA)


_TERM = re.compile(r"\w")


def dictionary(docs: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Literal terms of a dictionary in texts: leftmost, longest first, not overlapping, with offsets.

    The automaton is built once in each worker.
    """
    import ahocorasick

    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            a = ahocorasick.Automaton()
            for t, e in terms.items():
                if _TERM.search(t):
                    a.add_word(t, (t, e))
            a.make_automaton()
            held.append(a)
        for batch in batches:
            out = []
            for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                last = 0
                hits = sorted(((end + 1 - len(t), -len(t), t, e) for end, (t, e) in held[0].iter(text or "")), key=lambda h: h[:2]) if len(held[0]) else []
                for begin, minus, t, e in hits:
                    if begin >= last:
                        out.append((doc, e, begin, begin - minus, t))
                        last = begin - minus
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "entity", "begin", "end", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, entity string, begin int, end int, value string")
