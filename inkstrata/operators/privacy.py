"""Findings of personal data in texts: detection by pattern, replacement, restoring, risk."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.errors import AnonymizationFailed, PrivacyError
from inkstrata.functions.text import digest, mask, token

PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}",
    "PHONE_NUMBER": r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "CREDIT_CARD": r"\b[0-9]{16}\b",
}
HIGH_RISK = ("IBAN_CODE", "CREDIT_CARD", "US_SSN", "UK_NHS", "US_PASSPORT", "US_DRIVER_LICENSE", "MEDICAL_LICENSE", "IP_ADDRESS")
MODES = ("redact", "mask", "hash", "pseudonymize")


def detect(docs: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """doc_id, entity, begin, end, value of every match; patterns in order, offsets from 0, no overlap handling.

    Offsets come from running lengths of the pieces between matches, so that
    the scan stays in the JVM.
    """

    def one(entity: str, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
        between = F.split("text", pattern)
        size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
        return F.transform(found, lambda v, i: F.struct(F.lit(entity).alias("entity"), (size(between, i + 1) + size(found, i)).alias("begin"), v.alias("value")))

    some = docs.where(F.col("text").rlike("|".join(f"(?:{p})" for p in patterns.values())))
    # the outer form: the plain one would be preceded by a test of the list, for which all matches are sought twice
    rows = some.select("doc_id", F.explode_outer(F.flatten(F.array(*[one(e, p) for e, p in patterns.items()]))).alias("f")).where("f is not null")
    return rows.select("doc_id", "f.entity", "f.begin", (F.col("f.begin") + F.length("f.value")).alias("end"), "f.value")


def number(findings: DataFrame) -> DataFrame:
    """Pseudonym numbers by (document, entity): the order of first use from the end of the text backwards."""
    w = Window.partitionBy("doc_id", "entity")
    used = findings.withColumn("last_begin", F.max("begin").over(Window.partitionBy("doc_id", "entity", "value")))
    return used.withColumn("number", F.dense_rank().over(w.orderBy(F.desc("last_begin")))).drop("last_begin")


def replacement(mode: str, entity: Column, value: Column, number_: Column | None = None) -> Column:
    if mode == "redact":
        return F.lit("[REDACTED]")
    if mode == "mask":
        return mask(value)
    if mode == "hash":
        return digest(value)
    if mode == "pseudonymize":
        return token(entity, number_)
    raise ValueError(f"unknown mode {mode}")


def anonymize(docs: DataFrame, findings: DataFrame, mode: str) -> DataFrame:
    """``docs`` with the findings replaced from right to left; documents without any keep their text.

    Only ids and findings are grouped; each text is moved once, by the join on its id.
    """
    rows = number(findings) if mode == "pseudonymize" else findings.withColumn("number", F.lit(0))
    rows = rows.select("doc_id", "begin", "end", replacement(mode, F.col("entity"), F.col("value"), F.col("number")).alias("by"))
    spots = rows.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("begin", "end", "by")))).alias("spots"))
    splice = F.aggregate("spots", F.col("text"), lambda t, s: F.concat(F.left(t, s["begin"]), s["by"], F.substring(t, s["end"] + 1, F.length(t))))
    return docs.join(spots, "doc_id", "left").withColumn("text", F.when(F.col("spots").isNull(), F.col("text")).otherwise(splice)).drop("spots")


def mappings(findings: DataFrame) -> DataFrame:
    """doc_id, token and value, for restoring."""
    return number(findings).select("doc_id", token(F.col("entity"), F.col("number")).alias("token"), "value").distinct()


def restore(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tokens become their values again, the longest first."""
    pairs = mapping.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.length("token").alias("n"), "token", "value")))).alias("pairs"))
    back = F.aggregate("pairs", F.col("text"), lambda t, p: F.replace(t, p["token"], p["value"]))
    return docs.join(pairs, "doc_id", "left").withColumn("text", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(back)).drop("pairs")


def risk(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Share of the text, number of high-risk findings and of kinds, each capped, as one score."""
    sums = findings.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("chars"), F.count_if(F.col("entity").isin(*HIGH_RISK)).alias("high"), F.count_distinct("entity").alias("kinds"))
    rows = docs.select("doc_id", F.length("text").alias("size")).join(sums, "doc_id", "left")
    share = F.least(F.coalesce(F.col("chars") / F.nullif(F.col("size"), F.lit(0)), F.lit(0.0)), F.lit(1.0))
    score = 0.5 * share + F.least(0.1 * F.coalesce(F.col("high"), F.lit(0)), F.lit(0.3)) + F.least(0.05 * F.coalesce(F.col("kinds"), F.lit(0)), F.lit(0.2))
    return rows.select("doc_id", F.round(F.least(score, F.lit(1.0)), 4).alias("risk"))


def scrub(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """Matches in the string values of a trace become a mark."""
    out = text
    for p in patterns.values():
        out = F.regexp_replace(out, p, "[SCRUBBED]")
    return out


def numbered_terms(terms: DataFrame, key: str, order: str) -> DataFrame:
    """``root_n`` of each term by its first place in the list."""
    first = terms.groupBy(key, "term").agg(F.min(order).alias("first"))
    return first.select(key, "term", F.concat(F.col(key), F.lit("_"), F.dense_rank().over(Window.partitionBy(key).orderBy("first")).cast("string")).alias("token"))


# --- policies -------------------------------------------------------------------------------

FOUND_SCHEMA = "doc_id bigint, page int, entity string, begin int, end int, value string, literal string, error string"


@dataclass
class Policy:
    """What is replaced before a model sees a text, and how."""

    mode: str = "pseudonymize"
    reversible: bool = True
    entities: tuple[str, ...] = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "LOCATION", "DATE_TIME")
    fail_closed: bool = True
    least_score: float = 0.35
    providers: list[Callable] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise PrivacyError(f"unknown mode {self.mode}")
        if self.reversible and self.mode != "pseudonymize":
            raise PrivacyError("only pseudonyms are reversible")


class PatternTerms:
    """Patterns of one's own as a provider: each in turn, those that are masked before those with a literal; they may overlap.

    A provider takes a text and gives (entity, begin, end, value, literal); it is built in each worker.
    """

    def __init__(self, masked: dict[str, str] | None = None, literals: dict[str, str] | None = None, case_sensitive: bool = True):
        if not masked and not literals:
            raise PrivacyError("a dictionary needs terms")
        flags = 0 if case_sensitive else re.IGNORECASE
        self.rules = [(re.compile(p, flags), e, None) for p, e in (masked or {}).items()] + [(re.compile(p, flags), "CUSTOM", v) for p, v in (literals or {}).items()]

    def __call__(self, text: str) -> list[tuple[str, int, int, str, str | None]]:
        return [(e, m.start(), m.end(), m.group(), v) for p, e, v in self.rules for m in p.finditer(text)]


class LiteralTerms:
    """Words of one's own as a provider: leftmost, the longest first, never overlapping; a literal outranks the mask of the same word."""

    def __init__(self, masked: dict[str, str] | None = None, literals: dict[str, str] | None = None, case_sensitive: bool = True):
        if not masked and not literals:
            raise PrivacyError("a dictionary needs terms")
        self.fold = (lambda s: s) if case_sensitive else str.lower
        self.terms = {self.fold(t): (e, None) for t, e in (masked or {}).items() if t} | {self.fold(t): ("CUSTOM", v) for t, v in (literals or {}).items() if t}
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "fold": None, "folds": self.fold("A") == "a"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"fold": str.lower if state["folds"] else (lambda s: s)}

    def __call__(self, text: str) -> list[tuple[str, int, int, str, str | None]]:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t in self.terms:
                self._automaton.add_word(t, t)
            self._automaton.make_automaton()
        out, last = [], 0
        for begin, minus in sorted((end + 1 - len(t), -len(t)) for end, t in self._automaton.iter(self.fold(text))):
            if begin >= last:
                last = begin - minus
                entity, literal = self.terms[self.fold(text)[begin:last]]
                out.append((entity, begin, last, text[begin:last], literal))
        return out


def numbered(terms: list[str], root: str, start: int = 1, known: dict[str, str] | None = None) -> dict[str, str]:
    """``root_n`` for each term in the order of the list, once; a known mapping (kept from an earlier run) is taken as it is."""
    if known is not None:
        return dict(known)
    if not terms:
        raise PrivacyError("there are no terms to number")
    return {t: f"{root}_{start + k}" for k, t in enumerate(dict.fromkeys(terms))}


def detect_by(pages: DataFrame, build: Callable[[], list[Callable]]) -> DataFrame:
    """Findings of all providers, one after another, in pages (doc_id, page, text); overlaps stay.

    A page whose detection fails gives one row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        providers = build()
        for batch in batches:
            rows = []
            for doc, page, text in zip(batch["doc_id"], batch["page"], batch["text"]):
                if not text:
                    continue
                try:
                    rows += [(doc, page, *f, None) for p in providers for f in p(text)]
                except Exception as e:  # noqa: BLE001 - any failure of a provider is a row's error
                    rows.append((doc, page, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "entity", "begin", "end", "value", "literal", "error"]).astype({"begin": "Int32", "end": "Int32"})

    return pages.select("doc_id", F.col("page").cast("int").alias("page"), "text").mapInPandas(run, FOUND_SCHEMA)


def number_pages(findings: DataFrame) -> DataFrame:
    """Pseudonym numbers by (document, entity): in the order of first use, page by page, each page from its end backwards."""
    use = F.min(F.struct("page", (-F.col("begin")).alias("back"))).over(Window.partitionBy("doc_id", "entity", "value"))
    return findings.withColumn("use", use).withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id", "entity").orderBy("use"))).drop("use")


def anonymize_pages(pages: DataFrame, findings: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, page, text) with the findings replaced, and the mappings (doc_id, token, value, entity).

    A literal outranks the mode. Findings replace from right to left, each by itself, also where they overlap. Pages whose detection
    failed lose their text and get ``blocked``, or go through as they are if the policy is not to fail closed.
    """
    good = findings.where("error is null")
    rows = number_pages(good) if policy.mode == "pseudonymize" else good.withColumn("number", F.lit(0))
    rows = rows.withColumn("by", F.coalesce("literal", replacement(policy.mode, F.col("entity"), F.col("value"), F.col("number"))))
    spots = rows.groupBy("doc_id", "page").agg(F.reverse(F.array_sort(F.collect_list(F.struct("begin", "end", "by")))).alias("spots"))
    failed = findings.where("error is not null").groupBy("doc_id", "page").agg(F.first("error").alias("why"))
    splice = F.aggregate("spots", F.col("text"), lambda t, s: F.concat(F.left(t, s["begin"]), s["by"], F.substring(t, s["end"] + 1, F.length(t))))
    out = pages.join(spots, ["doc_id", "page"], "left").join(failed, ["doc_id", "page"], "left")
    text = F.when(F.col("why").isNotNull() & F.lit(policy.fail_closed), F.lit(None)).when(F.col("spots").isNull(), F.col("text")).otherwise(splice)
    blocked = F.when(F.lit(policy.fail_closed), F.col("why"))
    out = out.withColumn("text", text).withColumn("blocked", blocked).drop("spots", "why")
    tokens = rows.select("doc_id", F.col("by").alias("token"), "value", "entity").distinct() if policy.mode == "pseudonymize" else rows.limit(0).select("doc_id", F.col("by").alias("token"), "value", "entity")
    return out, tokens


def require_anonymized(pages: DataFrame) -> DataFrame:
    """The documents' texts, pages joined by blank lines; an error as soon as a page was blocked."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    why = F.first("blocked", ignorenulls=True)
    rows = pages.groupBy("doc_id").agg(joined.alias("text"), why.alias("why"))
    stop = F.raise_error(F.concat(F.lit(f"{AnonymizationFailed.__name__}: "), F.col("why"))).cast("string")
    return rows.select("doc_id", F.when(F.col("why").isNotNull(), stop).otherwise(F.col("text")).alias("text"))


def restore_values(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values (doc_id, field, value) with tokens turned back, the longest first."""
    own = fields.withColumn("row", F.struct("doc_id", "field"))
    pairs = mapping.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("token").alias("n"), "token", F.col("value").alias("was"))))).alias("pairs"))
    back = F.aggregate("pairs", F.col("value"), lambda t, p: F.replace(t, p["token"], p["was"]))
    return own.join(pairs, "doc_id", "left").withColumn("value", F.when(F.col("pairs").isNull(), F.col("value")).otherwise(back)).drop("pairs", "row")


def redaction_boxes(words: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, page, block, finding, entity, box: what is blacked out on a page image for each finding of a block's text.

    ``words``: doc_id, page, block, word, text, x0, y0, x1, y1, block_box; ``findings``: doc_id, page, block, finding, entity, begin, end.
    The words that a finding touches, else the whole block. Words are joined by single blanks in a block's text.
    """
    keys = ["doc_id", "page", "block"]
    w = Window.partitionBy(*keys).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("a", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).withColumn("z", F.col("a") + F.length("text"))
    hit = placed.join(findings, keys).withColumn("touched", (F.col("a") < F.col("end")) & (F.col("z") > F.col("begin")) & F.col("x0").isNotNull())
    side = lambda f, c: f(F.when(F.col("touched"), F.col(c)))
    rows = hit.groupBy(*keys, "finding", "entity").agg(F.max("touched").alias("some"), F.struct(side(F.min, "x0").alias("x0"), side(F.min, "y0").alias("y0"), side(F.max, "x1").alias("x1"), side(F.max, "y1").alias("y1")).alias("own"), F.first("block_box").alias("whole"))
    return rows.select(*keys, "finding", "entity", F.when(F.col("some"), F.col("own")).otherwise(F.col("whole")).alias("box"))
