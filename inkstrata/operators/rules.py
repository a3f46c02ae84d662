"""Validation of fields, review rules, status queues and the log of corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = 2, 1


def validate(fields: DataFrame, results: DataFrame, doc: str, required: list[str] = (), typed: list[str] = (), evidenced: list[str] = ()) -> DataFrame:
    """Messages of each field (doc, field, is_error, messages, message); an error outweighs a warning.

    ``fields`` has (doc, field, value, evidence); a required field may be absent there altogether.
    """
    seen = fields.groupBy(doc).agg(F.collect_set("field").alias("have"))
    missing = results.join(seen, doc, "left").select(doc, F.explode(F.array_except(F.array(*[F.lit(f) for f in required]), F.coalesce("have", F.array().cast("array<string>")))).alias("field"))
    out = missing.select(doc, "field", F.lit("required: field is missing").alias("message"), F.lit(ERROR).alias("severity"))
    checks = F.filter(
        F.array(
            F.struct(F.when(F.col("field").isin(*required) & F.col("value").isNull(), "required: value is null").alias("message"), F.lit(ERROR).alias("severity")),
            F.struct(F.when(F.col("field").isin(*typed) & (F.col("value") == ""), "type: value is empty").alias("message"), F.lit(WARNING).alias("severity")),
            F.struct(F.when(F.col("field").isin(*evidenced) & F.col("value").isNotNull() & ~F.col("evidence"), "evidence: value without evidence").alias("message"), F.lit(ERROR).alias("severity")),
        ),
        lambda x: x["message"].isNotNull(),
    )
    out = out.unionByName(fields.select(doc, "field", F.explode(checks).alias("e")).select(doc, "field", "e.*"))
    return out.groupBy(doc, "field").agg((F.max("severity") == ERROR).alias("is_error"), F.count("*").alias("messages"), F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("message"))


def confidence_below(confidence: Column, threshold: float) -> Column:
    return F.when(confidence < threshold, f"confidence below {threshold:.2f}")


def field_below(name: str, gate: Column) -> Column:
    return F.when(~gate, f"field {name} is not trusted")


def fields_missing(fields: dict[str, Column]) -> Column:
    names = F.filter(F.array(*[F.when(v.isNull(), n) for n, v in fields.items()]), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.concat(F.lit("missing: "), F.array_join(names, ", ")))


def has_errors(count: Column) -> Column:
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(" validation errors")))


def review(results: DataFrame, reasons: list[Column]) -> DataFrame:
    """``results`` with the reasons that hold, in the order of the rules, and whether there is any."""
    held = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return results.withColumn("reasons", held).withColumn("needs_review", F.size("reasons") > 0)


def approved(verdict: Column) -> Column:
    """A reviewer's words count as approval only if they begin with it; none is a refusal."""
    return F.coalesce(F.startswith(F.lower(F.trim(verdict)), F.lit("approved")), F.lit(False))


def status_queue(status: Column, needs_review: Column) -> Column:
    return F.when((status == "pending") & needs_review, "pending_review").otherwise(status)


def fold(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Corrections folded to the original and the last value of each field."""
    at = F.struct(*order)
    return log.groupBy(*key).agg(F.count("*").alias("corrections"), F.min_by("value", at).alias("original"), F.max_by("value", at).alias("corrected"))


def custom(results: DataFrame, doc: str, name: str, broken: Column, message: Column | str, field: Column | str | None = None, severity: int = ERROR) -> DataFrame:
    """A rule of one's own over whole results: (doc, field, rule, message, severity) where ``broken`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    at = F.lit(field).cast("string") if field is None or isinstance(field, str) else field
    return results.where(broken).select(doc, at.alias("field"), F.lit(name).alias("rule"), text.alias("message"), F.lit(severity).alias("severity"))


def statuses(fields: DataFrame, errors: DataFrame, doc: str) -> DataFrame:
    """``fields`` with status (error over warning over valid) and messages in the order of the rules, from ``errors`` (doc, field, severity, message, order)."""
    per = errors.groupBy(doc, "field").agg(F.max("severity").alias("worst"), F.transform(F.array_sort(F.collect_list(F.struct("order", "message"))), lambda x: x["message"]).alias("messages"))
    rows = fields.join(per, [doc, "field"], "left")
    status = F.when(F.col("worst") == ERROR, "error").when(F.col("worst") == WARNING, "warning").otherwise("valid")
    return rows.withColumn("status", status).withColumn("messages", F.coalesce("messages", F.array().cast("array<string>"))).drop("worst")


# Review rules over ``fields``, an array of structs with field, value, gate and evidence, in schema order.


def fields_untrusted(fields: Column, thresholds: dict[str, float]) -> Column:
    """The named fields that are not trusted, in the order of the rule; a threshold counts only if it is above zero."""
    wanted = [n for n, t in thresholds.items() if t > 0]
    bad = F.filter(F.array(*[F.when(F.exists(fields, lambda f: (f["field"] == n) & ~f["gate"]), F.lit(f"field {n} is not trusted")) for n in wanted]), lambda x: x.isNotNull()) if wanted else F.array().cast("array<string>")  # noqa: B023
    return F.when(F.size(bad) > 0, F.array_join(bad, "; "))


def first_untrusted(fields: Column) -> Column:
    """The first field that is not trusted."""
    name = F.try_element_at(F.filter(fields, lambda f: ~f["gate"]), F.lit(1))["field"]
    return F.when(name.isNotNull(), F.concat(F.lit("field "), name, F.lit(" is not trusted")))


def without_evidence(fields: Column, names: list[str] | None = None) -> Column:
    """Fields with a value and no evidence; no names or an empty list mean all fields."""
    bad = F.filter(fields, lambda f: f["value"].isNotNull() & ~f["evidence"] & (f["field"].isin(*names) if names else F.lit(True)))
    order = F.transform(bad, lambda f: f["field"]) if not names else F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.exists(bad, lambda f: f["field"] == n))
    return F.when(F.size(order) > 0, F.concat(F.lit("no evidence: "), F.array_join(order, ", ")))


def critical_missing(fields: Column, names: list[str]) -> Column:
    """Named fields that are absent or null."""
    gone = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.exists(fields, lambda f: (f["field"] == n) & f["value"].isNotNull()))
    return F.when(F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ", ")))


# Corrections and decisions


def correct(fields: DataFrame, log: DataFrame, doc: str, order: str) -> tuple[DataFrame, DataFrame]:
    """``fields`` (doc, field, value) after a log of corrections (doc, field, order, value, by, reason), and the corrections of unknown fields.

    The last value counts, the value before the first correction stays as ``original``.
    """
    last = log.groupBy(doc, "field").agg(F.max_by(F.struct("value", "by", "reason"), order).alias("c"), F.count("*").alias("corrections"))
    rows = fields.join(last, [doc, "field"], "left")
    done = F.col("c").isNotNull()
    rows = rows.withColumn("original", F.when(done, F.col("value"))).withColumn("value", F.when(done, F.col("c.value")).otherwise(F.col("value"))).withColumn("corrected", done).withColumn("corrected_by", F.col("c.by")).withColumn("correction_reason", F.col("c.reason"))
    return rows.withColumn("corrections", F.coalesce("corrections", F.lit(0))).drop("c"), log.join(fields.select(doc, "field"), [doc, "field"], "left_anti")


def decide(log: DataFrame, doc: str, order: str) -> DataFrame:
    """doc, status, by, at, reason, refused: the first decision (approved or rejected) stays, later ones are refused."""
    first = F.min_by(F.struct(F.col("decision").alias("status"), "by", F.col(order).alias("at"), "reason"), order)
    return log.where(F.col("decision").isin("approved", "rejected")).groupBy(doc).agg(first.alias("d"), (F.count("*") - 1).alias("refused")).select(doc, "d.*", "refused")


def provenance(fields: DataFrame, evidence: DataFrame, log: DataFrame, verdicts: DataFrame, results: DataFrame, doc: str, order: str = "seq") -> DataFrame:
    """Where each field's value comes from: first evidence, last correction, all reviewers' verdicts (the same for each field), the document's state.

    ``evidence``: doc, field, seq, text, page, block, confidence; ``verdicts``: doc, seq, reviewer, verdict; ``results``: doc, status, reviewed_by, model, parser.
    """
    rows, _ = correct(fields, log, doc, order)
    ev = evidence.groupBy(doc, "field").agg(F.min_by(F.struct("text", "page", "block", "confidence"), "seq").alias("e"))
    said = verdicts.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reviewer", "verdict"))), lambda v: F.concat(v["reviewer"], F.lit(": "), v["verdict"])).alias("verdicts"))
    out = rows.join(ev, [doc, "field"], "left").join(said, doc, "left").join(results.select(doc, "status", "reviewed_by", "model", "parser"), doc, "left")
    return out.select(
        doc, "field", "value", "original", "corrected", F.coalesce("e.text", F.lit("")).alias("source_text"), "e.page", "e.block", F.col("e.confidence").alias("evidence_confidence"), "model", "parser", (F.coalesce("status", F.lit("pending")) != "pending").alias("reviewed"),
        F.coalesce("status", F.lit("pending")).alias("status"), "reviewed_by", F.coalesce("verdicts", F.array().cast("array<string>")).alias("verdicts"), F.coalesce("corrected_by", F.lit("")).alias("corrected_by"), F.coalesce("correction_reason", F.lit("")).alias("correction_reason"),
    )
