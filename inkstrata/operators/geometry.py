"""Boxes on pages: algebra and the joins of words with lines, blocks and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A crop smaller than this, in pixels, is the whole page.
MIN_CROP = 10.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def relative(b: Column, width: Column, height: Column) -> Column:
    """Shares of the page's size; unchanged on a page without one."""
    ok = (width > 0) & (height > 0)
    return F.when(ok, box(b["x0"] / width, b["y0"] / height, b["x1"] / width, b["y1"] / height)).otherwise(b)


def absolute(b: Column, width: Column, height: Column) -> Column:
    """Page coordinates of shares, which are clamped to [0, 1] and put the right way round."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x, z, y, w = unit(b["x0"]), unit(b["x1"]), unit(b["y0"]), unit(b["y1"])
    return box(F.least(x, z) * width, F.least(y, w) * height, F.greatest(x, z) * width, F.greatest(y, w) * height)


def crop(b: Column, width: Column, height: Column, padding: float) -> Column:
    """The padded box within the page, or the page if that is too small."""
    out = box(F.greatest(b["x0"] - padding, F.lit(0.0)), F.greatest(b["y0"] - padding, F.lit(0.0)), F.least(b["x1"] + padding, width), F.least(b["y1"] + padding, height))
    small = (out["x1"] - out["x0"] < MIN_CROP) | (out["y1"] - out["y0"] < MIN_CROP)
    return F.when(small, box(F.lit(0.0), F.lit(0.0), width, height)).otherwise(out)


def union_box(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Aggregate: the least box around all."""
    return box(F.min(x0), F.min(y0), F.max(x1), F.max(y1))


def with_offsets(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Character offsets of words joined by single blanks."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    return words.withColumn("begin", begin).withColumn("end", begin + F.length("text"))


def words_of_lines(words: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose offset lies in a line's half-open range, joined within ``keys``."""
    return words.join(lines, keys).where((F.col("begin") >= F.col("line_begin")) & (F.col("begin") < F.col("line_end")))


def block_of_words(words: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The first block that holds each word's centre."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = words.join(blocks, keys).where((cx >= F.col("bx0")) & (cx <= F.col("bx1")) & (cy >= F.col("by0")) & (cy <= F.col("by1")))
    return inside.groupBy(*keys, "word").agg(F.min("block").alias("block"))


def overlaps(words: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Words that a finding touches: begins before its end, ends after its beginning."""
    f = findings.select(*keys, F.col("begin").alias("f_begin"), F.col("end").alias("f_end"), "entity")
    return words.join(f, keys).where((F.col("begin") < F.col("f_end")) & (F.col("end") > F.col("f_begin")))


def words_with_gaps(docs: DataFrame) -> DataFrame:
    """doc_id, word, text, begin, end: the words of a text between blanks, however many blanks there are."""
    words, gaps = F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1)), F.split("text", "[^ ]+")
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(1), F.size(words)).alias("g"))).alias("word", "x")).select("doc_id", "word", F.col("x.w").alias("text"), F.length("x.g").alias("gap"))
    w = Window.partitionBy("doc_id").orderBy("word")
    end = F.sum(F.col("gap") + F.length("text")).over(w)
    return rows.withColumn("end", end).withColumn("begin", F.col("end") - F.length("text")).drop("gap")
