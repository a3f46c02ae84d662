"""Tables as cells: headers, rows, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows(cells: DataFrame, keys: list[str], header: bool | None = None) -> DataFrame:
    """Texts of each row in the order of columns; only header rows or only data rows if asked."""
    kept = cells if header is None else cells.where(F.col("is_header") == header)
    return kept.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("texts"))


def cell_at(cells: DataFrame, row: Column, col: Column) -> DataFrame:
    """Cells whose span holds a place."""
    return cells.where((F.col("row") <= row) & (row < F.col("row") + F.col("row_span")) & (F.col("col") <= col) & (col < F.col("col") + F.col("col_span")))


def column_values(cells: DataFrame, keys: list[str], col: int) -> DataFrame:
    kept = cells.where((F.col("col") == col) & ~F.col("is_header"))
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda c: c["text"]).alias("texts"))


def records(cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row of named columns for each data row: the column's header, else ``col_n``; of equal names the last column wins.

    The headers of a table reach its cells by a window over the table, so cells are moved once, by ``keys``, and sorted once.
    """
    table = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = F.collect_list(F.when(F.col("is_header"), F.struct("col", "row", "text"))).over(table)
    own = F.array_min(F.filter("heads", lambda h: (h["col"] == F.col("col")) & h["row"].isNotNull()))["text"]
    data = cells.withColumn("heads", heads).where(~F.col("is_header")).withColumn("name", F.coalesce(own, F.concat(F.lit("col_"), F.col("col").cast("string"))))
    named = lambda n: F.col("name") == n
    return data.groupBy(*keys, "row").agg(*[F.max_by(F.when(named(n), F.col("text")), F.when(named(n), F.col("col"))).alias(n) for n in names])


def resolve_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Data cells with the texts of the column and row headers that span them, in order.

    ``cells``: keys, row, col, row_span, col_span, text, col_header, row_header.
    """
    heads = lambda flag, at, span, other: cells.where(flag).select(*keys, F.explode(F.sequence(F.col(at), F.col(at) + F.col(span) - 1)).alias(at), F.col(other).alias("o"), "text").groupBy(*keys, at).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]).alias(f"{at}_headers"))
    data = cells.where("not col_header and not row_header")
    out = data.join(heads("col_header", "col", "col_span", "row"), [*keys, "col"], "left").join(heads("row_header", "row", "row_span", "col"), [*keys, "row"], "left")
    none = F.array().cast("array<string>")
    return out.withColumn("col_headers", F.coalesce("col_headers", none)).withColumn("row_headers", F.coalesce("row_headers", none))
