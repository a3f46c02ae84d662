"""Comments, links, highlights, signatures and tracked changes of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.operators.geometry import box
from inkstrata.sources import docx

KINDS = {
    "comment": ("Text", "FreeText", "Popup"), "highlight": ("Highlight", "Underline", "StrikeOut", "Squiggly", "Ink"), "link": ("Link",), "widget": ("Widget",),
}
#: Highlight colours of Word by name.
WORD_COLOURS = {
    "yellow": "#ffff00", "green": "#00ff00", "cyan": "#00ffff", "magenta": "#ff00ff", "blue": "#0000ff", "red": "#ff0000", "darkBlue": "#000080", "darkCyan": "#008080", "darkGreen": "#008000", "darkMagenta": "#800080", "darkRed": "#800000",
    "darkYellow": "#808000", "darkGray": "#808080", "lightGray": "#c0c0c0", "black": "#000000", "white": "#ffffff",
}


def dispatch(path: Column) -> Column:
    """Which reader takes a file: ``docx``, ``unsupported`` for the old binary Word format, ``pdf`` for anything else."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending == "docx", "docx").when(ending == "doc", "unsupported").otherwise("pdf")


def colour(parts: Column) -> Column:
    """``#rrggbb`` of three shares or one of grey, cut to bytes; empty for anything else."""
    hexa = lambda v: F.lpad(F.lower(F.hex((v * 255).cast("int").cast("bigint"))), 2, "0")
    three = F.concat(F.lit("#"), hexa(parts[0]), hexa(parts[1]), hexa(parts[2]))
    one = F.concat(F.lit("#"), hexa(parts[0]), hexa(parts[0]), hexa(parts[0]))
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 1, one).otherwise("")


def word_colour(name: Column) -> Column:
    """The colour of a highlight of Word; the name itself if it is none of Word's."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in WORD_COLOURS.items() for x in p]), name), name)


def pdf_box(rect: Column, height: Column) -> Column:
    """A rectangle of PDF (from the bottom left) with its origin at the top left; null if it has not four numbers."""
    return F.when(F.size(rect) == 4, box(rect[0], height - rect[3], rect[2], height - rect[1]))


def inherited(own: Column, parent: Column) -> Column:
    """What a form widget says, else what its field says."""
    return F.coalesce(own, parent)


def pdf_annotations(rows: DataFrame) -> DataFrame:
    """Annotations of PDF pages by kind: doc_id, page, nth, kind, subtype, author, date, text, target, colour, signed, box.

    ``rows`` are what an adapter reads: doc_id, page, nth, subtype, title, modified, contents, colour (array), rect (array), height, action, uri, dest, and of widgets
    type, parent_type, parent_title, has_value, parent_has_value, signer. Widgets other than signatures, and other subtypes, are left out.
    """
    kind = F.when(F.lit(False), "")
    for name, subtypes in KINDS.items():
        kind = kind.when(F.col("subtype").isin(*subtypes), name)
    rows = rows.withColumn("kind", kind).where("kind is not null")
    field_type = inherited(F.col("type"), F.col("parent_type"))
    rows = rows.where((F.col("kind") != "widget") | (field_type == "/Sig"))
    target = F.when(F.col("action") == "URI", F.col("uri")).when(F.col("action") == "GoTo", F.concat(F.lit("internal:"), F.coalesce("dest", F.lit("")))).otherwise("")
    return rows.select(
        "doc_id", "page", "nth", F.when(F.col("kind") == "widget", "signature").otherwise(F.col("kind")).alias("kind"), "subtype", F.when(F.col("kind") == "widget", F.col("signer")).otherwise(F.col("title")).alias("author"), F.col("modified").alias("date"),
        F.when(F.col("kind") == "widget", inherited(F.col("title"), F.col("parent_title"))).otherwise(F.col("contents")).alias("text"), F.when(F.col("kind") == "link", target).alias("target"), F.when(F.col("kind") == "highlight", colour(F.col("colour"))).alias("colour"),
        F.when(F.col("kind") == "widget", F.coalesce("has_value", F.lit(False)) | F.coalesce("parent_has_value", F.lit(False))).alias("signed"), pdf_box(F.col("rect"), F.col("height")).alias("box"),
    )


def read_metadata(files: DataFrame, pdf: Callable[[], Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """doc_id, kind, author, text, target, error of files (doc_id, path, content): Word files here, PDF by an adapter that gives dicts of kind, author, text, target."""
    which = files.withColumn("reader", dispatch(F.col("path")))
    word = docx.read_annotations(which.where("reader = 'docx'"))
    old = which.where("reader = 'unsupported'").select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("kind", "author", "text", "target")], F.lit("the old binary Word format is not supported").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = pdf() if pdf else None
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    if read is None:
                        raise ModuleNotFoundError("no reader for PDF is given")
                    rows += [(doc, a.get("kind"), a.get("author"), a.get("text"), a.get("target"), None) for a in read(bytes(content))]
                except Exception as e:  # noqa: BLE001 - any failure of a reader is a row's error
                    rows.append((doc, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "author", "text", "target", "error"])

    return word.unionByName(old).unionByName(which.where("reader = 'pdf'").select("doc_id", "content").mapInPandas(run, docx.SCHEMA))
