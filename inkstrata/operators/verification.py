"""Second readings of weak fields, and sharding of wide schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions.text import squeeze

MIN_CONSENSUS, MIN_OCR, MAX_FIELDS = 0.7, 0.6, 5


def reason(consensus: Column, found: Column, value: Column, ocr: Column | None = None) -> Column:
    """The first trigger that holds, null if the field needs no second reading."""
    out = F.when(consensus < MIN_CONSENSUS, "consensus")
    if ocr is not None:
        out = out.when(ocr < MIN_OCR, "ocr")
    return out.when(~found & value.isNotNull(), "unmatched")


def queue(fields: DataFrame, max_fields: int = MAX_FIELDS, doc: str = "doc_id") -> DataFrame:
    """The first ``max_fields`` weak fields of each document in schema order (``pos``)."""
    weak = fields.withColumn("reason", reason(F.col("consensus"), F.col("found"), F.col("value"))).where("reason is not null")
    return weak.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("pos"))).where(F.col("rank") <= max_fields)


def region(*boxes: Column) -> Column:
    """The best known place of a field: the first of OCR box, OCR rectangle, evidence box, evidence rectangle, page."""
    return F.coalesce(*boxes)


def apply(fields: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """``fields`` with the second reading: ``agrees``, ``applied``, the value and the gate after it.

    An unreadable (null) second value changes nothing; one that agrees confirms
    the gate; another one replaces the value and sets the gate.
    """
    both = fields.join(second, on, "left")
    agrees = F.coalesce(squeeze(F.col("verified")) == squeeze(F.col("value")), F.lit(False))
    applied = F.col("verified").isNotNull() & ~agrees
    return both.withColumn("agrees", agrees).withColumn("applied", applied).withColumn("value", F.when(applied, F.col("verified")).otherwise(F.col("value"))).withColumn("gate", F.when(F.col("agrees") | F.col("applied"), F.lit(True)).otherwise(F.col("gate")))


def shards(fields: DataFrame, schema: str, order: str, parts: int) -> DataFrame:
    """Contiguous groups of ceil(n / parts) fields of each schema; never more groups than fields."""
    own = Window.partitionBy(schema)
    pos = F.row_number().over(own.orderBy(order)) - 1
    n = F.count("*").over(own)
    return fields.withColumn("shard", F.floor(pos / F.ceil(n / F.least(F.lit(parts), n))))
