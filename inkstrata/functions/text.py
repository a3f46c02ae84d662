"""Normalisation, coercion and formatting of values, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCY = "$€£¥,"
_WORDS = "[0-9a-z]+"
STOP_WORDS = ("a", "an", "and", "for", "in", "is", "no", "number", "of", "on", "the", "to", "value")
PALETTE = ("#ffd54f", "#81c784", "#64b5f6", "#e57373", "#ba68c8", "#4db6ac", "#ffb74d", "#a1887f")


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(x), body)[0]


def squeeze(x: Column) -> Column:
    """For locating: lower case, no currency signs or commas, single blanks, no blanks at the ends."""
    return strip(F.regexp_replace(F.translate(F.lower(x), CURRENCY, ""), r"\s+", " "))


def plain(x: Column) -> Column:
    """For comparing candidates: stripped, lower case, no currency signs or commas; inner blanks stay."""
    return F.translate(F.lower(strip(x)), CURRENCY, "")


def scored(x: Column) -> Column:
    """For evaluation: as ``squeeze`` without ``%``; ends are stripped before the signs go, not after."""
    return F.regexp_replace(F.translate(F.lower(strip(x)), CURRENCY + "%", ""), r"\s+", " ")


def key(x: Column) -> Column:
    """For matching names: ASCII letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def found_in(value: Column, source: Column) -> Column:
    """Whether the value, if there is one, occurs in the source after ``plain``."""
    v = plain(value)
    return F.coalesce((v != "") & F.contains(plain(source), v), F.lit(False))


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Equal, or one within the other, after ``scored``; empty values match nothing."""
    x, y = scored(a), scored(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def to_number(x: Column) -> Column:
    """First number of a string; parentheses make it negative; null if there is none."""
    digits = F.regexp_extract(F.translate(x, ",$€£¥%", ""), r"[-+]?[0-9]+([.][0-9]+)?", 0).try_cast("double")
    return F.when(strip(x).rlike(r"^\(.*\)$"), -F.abs(digits)).otherwise(digits)


def to_bool(x: Column) -> Column:
    v = F.lower(strip(x))
    return F.when(v.isin("true", "yes", "y", "1"), F.lit(True)).when(v.isin("false", "no", "n", "0"), F.lit(False))


def unfence(x: Column) -> Column:
    """Without a code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```(json)?\s*", ""), r"\s*```$", ""))


def temperatures(n: Column, mean: float = 0.3) -> Column:
    """``n`` temperatures evenly over mean -0.15 .. +0.15, within [0, 1]; one instance has the mean."""
    step = F.lit(0.3) / F.greatest(n - 1, F.lit(1))
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(mean - 0.15) + i * step)), 3))
    return F.when(n <= 1, F.array(F.lit(mean))).otherwise(grid)


def base_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def context(page: Column, needle: Column, chars: int) -> Column:
    """``chars`` characters on either side of the first occurrence, with ellipses where cut; the needle if absent."""
    at = F.call_function("instr", F.lower(page), F.lower(needle))
    start = F.greatest(at - chars, F.lit(1))
    stop = F.least(at + F.length(needle) + chars - 1, F.length(page))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(page, start, stop - start + 1), F.when(stop < F.length(page), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(needle)


def mask(x: Column) -> Column:
    """First character and stars; a single character is a star."""
    return F.when(F.length(x) > 1, F.concat(F.left(x, F.lit(1)), F.repeat(F.lit("*"), F.length(x) - 1))).otherwise(F.repeat(F.lit("*"), F.length(x)))


def digest(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(16))


def token(kind: Column, number: Column) -> Column:
    return F.format_string("%s_%03d", kind, number)


def palette(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.pmod(i, F.lit(len(PALETTE))) + 1).cast("int"))


def shrink_font(chars: Column, size: Column, width: Column) -> Column:
    """Font size at which the text fits a width, a glyph being half as wide as high; not under 6."""
    need = chars * size * 0.5
    return F.when(need <= width, size).otherwise(F.greatest(F.lit(6.0), size * width / need))


def phrase_score(phrase: Column, label: Column) -> Column:
    """1 if either contains the other (as keys), else the share of the phrase's words that the label has."""
    p, l = key(phrase), key(label)
    words = F.filter(F.regexp_extract_all(F.lower(phrase), F.lit(f"({_WORDS})"), F.lit(1)), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    have = F.regexp_extract_all(F.lower(label), F.lit(f"({_WORDS})"), F.lit(1))
    share = F.size(F.filter(words, lambda w: F.array_contains(have, w))) / F.nullif(F.size(words), F.lit(0))
    return F.when((p == "") | (l == ""), F.lit(0.0)).when(F.contains(l, p) | F.contains(p, l), F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def text_of(x: Column) -> Column:
    """A double as text without an exponent, whole numbers with one decimal."""
    whole = x == F.floor(x)
    return F.when(whole, F.concat(x.cast("decimal(30,0)").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(x.cast("decimal(30,6)").cast("string"), "0+$", ""))
