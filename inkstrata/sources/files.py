"""Files as documents: listing, kinds and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions.text import base_name

#: ending -> (type, kind)
TYPES = {
    "pdf": ("application/pdf", "pdf"), "png": ("image/png", "image"), "jpg": ("image/jpeg", "image"), "jpeg": ("image/jpeg", "image"), "tif": ("image/tiff", "image"), "tiff": ("image/tiff", "image"),
    "bmp": ("image/bmp", "image"), "gif": ("image/gif", "image"), "webp": ("image/webp", "image"), "txt": ("text/plain", "text"), "md": ("text/markdown", "text"), "html": ("text/html", "html"),
    "htm": ("text/html", "html"), "xml": ("application/xml", "text"), "json": ("application/json", "text"), "csv": ("text/csv", "text"), "eml": ("message/rfc822", "email"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"), "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "office"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet"),
}


def _lookup(path: Column, column: int) -> Column:
    ending = F.lower(F.regexp_extract(base_name(path), "[.]([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for e, pair in TYPES.items() for x in (e, pair[column])])
    return F.try_element_at(known, ending)


def mime_of(path: Column) -> Column:
    """Type of a file by its ending, null for any other."""
    return _lookup(path, 0)


def kind_of(path: Column) -> Column:
    """Kind of a file by its ending, ``unknown`` for any other."""
    return F.coalesce(_lookup(path, 1), F.lit("unknown"))


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark at the beginning, else Latin-1, which never fails."""
    text = content.cast("string")
    utf8 = F.regexp_replace(text, "^\ufeff", "")
    return F.when(F.is_valid_utf8(text), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id (a hash of the path), path, kind, content and its hash of all files under ``path``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", kind_of(F.col("path")).alias("kind"), F.sha2("content", 256).alias("content_hash"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path and text of the text, HTML and e-mail files under ``path``."""
    from inkstrata.sources.html import text_of

    rows = read_files(spark, path).where(F.col("kind").isin("text", "html", "email"))
    text = decoded(F.col("content"))
    return rows.select("doc_id", "path", F.when(F.col("kind") == "html", text_of(text)).otherwise(text).alias("text"))


def write_results(results: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """Results as Parquet, JSON lines or CSV, by ``partition`` where one is named."""
    out = results.write.format(fmt).mode("append")
    (out.partitionBy(partition) if partition else out).save(path)
