"""The document model as tables: pages, blocks and words of plain text, OCR confidence, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions.text import squeeze

MIN_CHARS_A_PAGE = 20
LOW_WORD, MIN_OCR, MAX_LOW_SHARE = 0.6, 0.6, 0.4


def pages_of(text: Column) -> Column:
    """Pages are parted by form feeds."""
    return F.split(text, "\\f")


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, page, block (number in its page), text; blocks are the lines of a page that aren't blank."""
    pages = docs.select("doc_id", F.posexplode(pages_of(F.col("text"))).alias("page", "page_text"))
    lines = pages.select("doc_id", "page", F.posexplode(F.filter(F.split("page_text", "\n"), lambda x: F.trim(x) != "")).alias("block", "text"))
    return lines


def words(docs: DataFrame) -> DataFrame:
    """One row for each word: doc_id, page, block, word (number in its block), text. Positions come from arrays, so nothing is shuffled."""
    tokens = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    return blocks(docs).select("doc_id", "page", "block", F.posexplode(tokens).alias("word", "text"))


def stream(docs: DataFrame) -> DataFrame:
    """Words with a position through the whole document, without those that normalise to nothing."""
    kept = words(docs).where(squeeze(F.col("text")) != "")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block", "word")) - 1)


def weak_pages(docs: DataFrame) -> DataFrame:
    """Pages with fewer than ``MIN_CHARS_A_PAGE`` characters that aren't blank."""
    pages = docs.select("doc_id", F.posexplode(pages_of(F.col("text"))).alias("page", "page_text"))
    return pages.withColumn("chars", F.length(F.regexp_replace("page_text", "\\s", ""))).where(F.col("chars") < MIN_CHARS_A_PAGE)


def is_weak(text: Column, n_text_blocks: Column, has_image: Column) -> Column:
    """A page that should be read by OCR: little text, no text block, an image and not much text, or over a tenth of private-use characters."""
    size = F.length(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    private = F.regexp_count(text, F.lit("[\\x{F000}-\\x{FFFF}]"))
    return (size < MIN_CHARS_A_PAGE) | (n_text_blocks == 0) | (has_image & (size < 100)) | (private > 0.1 * F.length(text))


def word_confidence(word: Column) -> Column:
    """A stand-in for OCR: a fixed function of the word's length."""
    return (F.length(word) * 37 % 100).cast("double") / 100


def confidence(words_: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence, number of words and share of weak ones."""
    low = (F.col("confidence") < LOW_WORD).cast("double")
    return words_.groupBy(*keys).agg(F.round(F.avg("confidence"), 4).alias("ocr_score"), F.count("confidence").alias("n_words"), F.round(F.avg(low), 4).alias("low_share"))


def escalation(chars: Column, pages: Column, score: Column, low_share: Column) -> Column:
    """Why a document should be read as images, null if its text will do."""
    return F.when(chars < MIN_CHARS_A_PAGE * pages, "too little text").when(score.isNull(), F.lit(None)).when(score < MIN_OCR, "low confidence").when(low_share > MAX_LOW_SHARE, "many weak words")


def lines_by_gap(words_: DataFrame, keys: list[str], order: str, begin: str, end: str, gap: float) -> DataFrame:
    """Numbers the lines of words: a new one begins where the gap to the word before exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    jump = F.coalesce((F.col(begin) - F.lag(end).over(w) > gap).cast("int"), F.lit(0))
    return words_.withColumn("jump", jump).withColumn("line", F.sum("jump").over(w)).drop("jump")
