"""Roll-ups over results: batches, routes, comparison, quality and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions.text import fuzzy_equal, scored

COMPLETE, EVIDENCE, GROUNDED, GATE, ACCEPT = 0.15, 0.25, 0.25, 0.20, 0.15


def batch(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """total, succeeded, failed, needs_review, approved and mean confidence in one pass over (success, needs_review, approved, confidence)."""
    ok = F.col("success")
    mean = F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0))
    return results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("needs_review")).alias("needs_review"), F.count_if(ok & F.col("approved")).alias("approved"), F.round(mean, 6).alias("confidence"))


def top_reasons(results: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent review reasons; of ties the one met first."""
    rows = results.select(order, F.posexplode("reasons").alias("pos", "reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("count"), F.min(F.struct(order, "pos")).alias("first")).orderBy(F.desc("count"), "first").limit(n).select("reason", "count")


def compare(fields: DataFrame, group: str, doc: str) -> DataFrame:
    """How the documents of a group agree field by field; a document that lacks a field has an empty value."""
    docs = fields.select(group, doc).distinct()
    names = fields.select(group, "field").distinct()
    every = docs.join(names, group).join(fields, [group, doc, "field"], "left")
    values = every.groupBy(group, "field", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    top = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return values.groupBy(group, "field").agg(F.count("*").alias("distinct_values"), (F.count("*") <= 1).alias("agree"), F.max("n").alias("most"), top.alias("most_common"))


def quality(fields: DataFrame, doc: str) -> DataFrame:
    """Rates and score of each document from (value, evidence, found, gate, corrected); absent fields only count against completeness."""
    has = F.col("value").isNotNull()
    present = F.nullif(F.count_if(has), F.lit(0))
    share = lambda c: F.round(F.coalesce(F.count_if(has & c) / present, F.lit(0.0)), 4)
    out = fields.groupBy(doc).agg(
        F.round(F.count_if(has) / F.count("*"), 4).alias("completeness"), share(F.col("evidence")).alias("evidence_rate"), share(F.col("found")).alias("grounding_rate"),
        share(F.col("gate")).alias("accept_rate"), share(F.col("corrected")).alias("correction_rate"),
    )
    return out.withColumn("score", F.round(COMPLETE * F.col("completeness") + EVIDENCE * F.col("evidence_rate") + GROUNDED * F.col("grounding_rate") + (GATE + ACCEPT) * F.col("accept_rate"), 4))


def field_score(evidence: Column, found: Column, gate: Column) -> Column:
    return 0.3 * evidence.cast("int") + 0.3 * found.cast("int") + 0.4 * gate.cast("int")


def worst_fields(fields: DataFrame, doc: str, n: int = 3) -> DataFrame:
    """The ``n`` fields of each document with the least scores under 1, in schema order where equal."""
    weak = fields.where(F.col("value").isNotNull()).withColumn("field_score", field_score(F.col("evidence"), F.col("found"), F.col("gate"))).where("field_score < 1")
    return weak.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("field_score", "pos"))).where(F.col("rank") <= n)


def evaluate(truth: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """Outcome of each true field: missing, exact, fuzzy, hallucinated or wrong. Of several predictions the last (``order``) counts."""
    last = predicted.groupBy(*on).agg(F.max_by(F.struct("value", "found"), "order").alias("p"))
    rows = truth.join(last, on, "left")
    got, want = F.col("p.value"), F.col("expected")
    outcome = F.when(got.isNull(), "missing").when(scored(got) == scored(want), "exact").when(fuzzy_equal(got, want), "fuzzy").when(~F.col("p.found"), "hallucinated").otherwise("wrong")
    return rows.withColumn("outcome", outcome)


def accuracy(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.col("outcome").isin("exact", "fuzzy")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("exact", "fuzzy", "missing", "hallucinated", "wrong")]
    return outcomes.groupBy(*keys).agg(F.count("*").alias("total"), *counts, F.round(F.count_if(hit) / F.count("*"), 4).alias("accuracy"))


def exact_mean(x: Column, digits: int = 4, places: int = 12) -> Column:
    """Aggregate: a rounded mean of doubles that does not depend on the order of summation."""
    return F.round(F.sum(x.cast(f"decimal(38,{places})")) / F.count(x), digits).cast("double")


def names_in_order(fields: DataFrame, order: list[str]) -> DataFrame:
    """Each field's name once, numbered by its first place."""
    first = fields.groupBy("field").agg(F.min(F.struct(*order)).alias("first"))
    return first.select("field", F.row_number().over(Window.orderBy("first")).alias("n"))


def differences(fields: DataFrame, docs: DataFrame, order: str) -> DataFrame:
    """field, all_agree, unique_values (by first place), value_counts, summary over documents (doc_id, ``order``) that have or lack the fields.

    A field that a document lacks is ``None`` there. Values are compared as texts, so lists and objects may be compared too.
    """
    every = docs.select("doc_id", order).join(fields.select("field").distinct(), how="cross").join(fields.select("doc_id", "field", "value"), ["doc_id", "field"], "left")
    values = every.groupBy("field", F.coalesce("value", F.lit("None")).alias("v")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    ranked = F.array_sort(F.collect_list(F.struct("first", "v", "n")))
    rows = values.groupBy("field").agg(ranked.alias("r"), F.sum("n").alias("total"))
    common = F.array_sort(F.transform("r", lambda x: F.struct((-x["n"]).alias("o"), x["first"].alias("first"), x["v"].alias("v"), x["n"].alias("n"))))
    said = F.array_join(F.transform(common, lambda x: F.concat(x["n"].cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" say "), x["v"])), ", ")
    agree = F.size("r") <= 1
    return rows.select("field", agree.alias("all_agree"), F.transform("r", lambda x: x["v"]).alias("unique_values"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["v"], x["n"]))).alias("value_counts"), F.when(agree, F.concat(F.lit("all "), F.col("total").cast("string"), F.lit(" documents agree: "), F.col("r")[0]["v"])).otherwise(said).alias("summary"))


def field_warnings(evidence: Column, found: Column, gate: Column, agreement: Column, value: Column) -> Column:
    """The one warning of a field: missing, no evidence, not found, disagreement, not accepted; null if there is none."""
    return F.when(value.isNull(), "missing").when(~evidence, "no evidence").when(~found, "not found in source").when(~gate & (agreement > 0) & (agreement < 1), "disagreement").when(~gate, "not accepted")


def worst_of_batch(fields: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` fields of a batch with the least mean field score under the mean score, which is not rounded; in order of first place where equal.

    ``fields``: field, pos, value, evidence, found, gate of all documents; a missing value counts as 0. ``scores``: score of each document.
    """
    one = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(field_score(F.col("evidence"), F.col("found"), F.col("gate")))
    per = fields.groupBy("field").agg((F.sum(one.cast("decimal(38,12)")) / F.count("*")).cast("double").alias("mean"), F.min("pos").alias("pos"))
    level = scores.agg((F.sum(F.col("score").cast("decimal(38,12)")) / F.count("score")).cast("double").alias("level"))
    weak = per.join(level, how="cross").where("mean < level")  # one row on the right
    return weak.withColumn("rank", F.row_number().over(Window.orderBy("mean", "pos"))).where(F.col("rank") <= n).select("field", "mean", "rank")


def overall(outcomes: DataFrame) -> DataFrame:
    """Accuracy over all fields and rates of hallucination and correction, of documents that have a prediction at all (``predicted``)."""
    rows = outcomes.where("predicted")
    n = F.nullif(F.count("*"), F.lit(0))
    share = lambda c: F.coalesce(F.round(F.count_if(c) / n, 4), F.lit(0.0))
    return rows.agg(share(F.col("outcome").isin("exact", "fuzzy")).alias("accuracy"), share(F.col("outcome") == "hallucinated").alias("hallucination_rate"), share(F.col("corrected") & (F.col("outcome") != "missing")).alias("correction_rate"))


def batch_csv(results: DataFrame, names: list[str]) -> DataFrame:
    """The columns of the batch file: name, success, confidence to three places, needs_review, then the fields; what is absent is empty."""
    return results.select(F.col("file_name"), F.initcap(F.col("success").cast("string")).alias("success"), F.round("confidence", 3).cast("string").alias("confidence"), F.initcap(F.col("needs_review").cast("string")).alias("needs_review"), *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])


def merged_shards(parts: DataFrame) -> DataFrame:
    """doc_id and the union of its shards' results: of equal fields the later shard's, usage summed, the first OCR score there is.

    ``parts``: doc_id, shard, fields (map), gates (map), tokens, cost, ocr.
    """
    later = lambda c: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.map_entries(c).alias("m")))), lambda x: x["m"]), F.array().cast(parts.select(F.map_entries(c)).schema[0].dataType), lambda acc, m: F.concat(F.filter(acc, lambda a: ~F.exists(m, lambda b: b["key"] == a["key"])), m))
    rows = parts.groupBy("doc_id").agg(F.map_from_entries(later("fields")).alias("fields"), F.map_from_entries(later("gates")).alias("gates"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("cost").cast("decimal(38,12)")).cast("double"), 6).alias("cost"), F.min_by("ocr", F.when(F.col("ocr").isNotNull(), F.col("shard"))).alias("ocr"))
    on = F.size(F.filter(F.map_values("gates"), lambda g: g))
    return rows.withColumn("confidence", F.coalesce(on / F.nullif(F.size(F.map_values("gates")), F.lit(0)), F.lit(0.0)))


def highlight_rects(evidence: DataFrame, ocr: DataFrame | None, names: list[str]) -> DataFrame:
    """doc_id, page, field, box, colour number: the rectangles of each field's evidence, else its box, and those of its OCR place.

    ``evidence`` and ``ocr``: doc_id, field, page, box, rects (array of page and box).
    """
    def of(rows: DataFrame) -> DataFrame:
        own = F.when(F.size("rects") > 0, F.col("rects")).when(F.col("box").isNotNull() & F.col("page").isNotNull(), F.array(F.struct(F.col("page").cast("int").alias("page"), F.col("box"))))
        return rows.where(F.col("field").isin(*names)).select("doc_id", "field", F.explode(own).alias("r")).select("doc_id", "field", "r.page", "r.box").where("box is not null")

    both = of(evidence) if ocr is None else of(evidence).unionByName(of(ocr))
    order = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("field"))
    return both.withColumn("colour", F.pmod(order, F.lit(8)))
