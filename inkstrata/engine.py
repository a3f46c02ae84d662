"""The engine as one call: documents in, fields, results and reports out.

``Engine`` holds what a workflow is: a schema, a model, rules, a policy. ``run`` is
a chain of DataFrame transformations over any number of documents; a single file
is a table of one. A configuration (mapping or YAML) and an engine turn into each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.errors import InkstrataError, PrivacyError, SchemaError, UnsupportedFileType, WorkflowError
from inkstrata.functions.text import base_name
from inkstrata.operators import documents as dm
from inkstrata.operators import extraction, locate, parsing, privacy, reports, rules
from inkstrata.operators import schema as sc
from inkstrata.operators.verification import MAX_FIELDS, MIN_CONSENSUS
from inkstrata.sources import files
from inkstrata.sources.store import Store

VERSION = "1.0"
_KEYS = {
    "name", "version", "description", "schema", "parser", "model", "extraction_type", "extraction_mode", "escalation", "verification", "schema_shards", "n_instances", "temperatures", "vision_dpi", "context", "normalize_output", "validation", "review", "privacy", "storage", "llm", "quality_threshold",
}
_VALIDATION = ("required_fields", "evidence_required", "type_validation")
_REVIEW = ("overall_confidence_below", "field_confidence_below", "any_field_confidence_below", "has_validation_errors", "field_missing", "no_evidence", "llm_reviewer")


@dataclass
class Engine:
    schema: sc.Schema
    model: Callable[[], Callable] | None = None  # builds the model in each worker
    look: Callable[[], Callable] | None = None  # builds a model that sees pictures
    name: str = "workflow"
    version: str = VERSION
    description: str = ""
    parser: str | dict | None = "auto"
    model_name: str = ""
    extraction_type: str = "text"  # text, vision, hybrid or auto
    options: extraction.Options = field(default_factory=extraction.Options)
    validation: list[dict] = field(default_factory=list)
    custom_rules: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    review: list[dict] = field(default_factory=list)
    policy: privacy.Policy | None = None
    storage: str | None = None
    quality_threshold: float = 0.7

    def __post_init__(self) -> None:
        kind = self.parser.get("type", "auto") if isinstance(self.parser, dict) else self.parser
        if self.extraction_type not in ("text", "vision", "hybrid", "auto"):
            raise WorkflowError(f"unknown extraction type {self.extraction_type}")
        if self.extraction_type in ("vision", "hybrid") and kind not in (None, "none", "auto"):
            raise WorkflowError(f"{self.extraction_type} extraction reads the pages themselves and takes no parser")
        if self.extraction_type in ("vision", "hybrid") and self.policy is not None:
            raise PrivacyError(f"{self.extraction_type} extraction would show a model what the policy hides")
        for rule in self.validation:
            if not set(rule) & set(_VALIDATION):
                raise WorkflowError(f"unknown validation rule {sorted(rule)}")
        for rule in self.review:
            if not set(rule) & set(_REVIEW):
                raise WorkflowError(f"unknown review rule {sorted(rule)}")

    # --- configuration ----------------------------------------------------------------------

    @classmethod
    def from_config(cls, config: dict | str | Path, model: Callable | None = None, look: Callable | None = None) -> Engine:
        """From a mapping, YAML text, or the path of a YAML file; unknown keys are errors."""
        if isinstance(config, Path) or isinstance(config, str) and "\n" not in config and config.endswith((".yaml", ".yml")):
            config = Path(config).read_text(encoding="utf-8")
        if isinstance(config, str):
            import yaml

            config = yaml.safe_load(config)
        unknown = set(config) - _KEYS
        if unknown:
            raise WorkflowError(f"unknown keys: {sorted(unknown)}")
        options = extraction.Options(config.get("extraction_mode", "single"), config.get("n_instances", 5), config.get("temperatures"), config.get("schema_shards") or 1, config.get("context") or "", bool(config.get("normalize_output", False)), **{k: v for k, v in (config.get("llm") or {}).items() if k in ("retries", "wait")})
        p = config.get("privacy")
        policy = privacy.Policy(**{k: tuple(v) if k == "entities" else v for k, v in p.items() if k in ("mode", "reversible", "entities", "fail_closed", "least_score")}) if p else None
        if policy and (given := p.get("provider")):
            policy.providers = [provider(g) for g in (given.get("providers", []) if isinstance(given, dict) and given.get("type") == "composite" else [given])]
        storage = config.get("storage")
        if isinstance(storage, dict):
            if storage.get("type", "local") not in ("local", "tables"):
                raise WorkflowError(f"unknown storage {storage.get('type')}")
            storage = storage.get("path")
        schema = sc.schema_of({"name": config.get("name", "workflow"), "fields": config.get("schema", {})})
        return cls(schema, model, look, config.get("name", "workflow"), str(config.get("version", VERSION)), config.get("description", ""), config.get("parser", "auto"), config.get("model", ""), config.get("extraction_type", "text"), options, config.get("validation", []), [], config.get("review", []), policy, storage, config.get("quality_threshold", 0.7))

    def export(self) -> dict:
        """The configuration of this engine; rules that are code, the policy and the models cannot be written and are left out."""
        def spec(f: sc.Field) -> dict:
            kind = f.kind if f.kind in ("str", "int", "float", "bool", "date", "datetime") else "list" if f.kind == "list" and (f.item is None or f.item.kind == "str") else "str"
            return {"type": kind} | ({"required": True} if f.required else {}) | ({"default": f.default} if f.default is not None else {}) | ({"description": f.description} if f.description else {})

        o = self.options
        out: dict[str, Any] = {"name": self.name, "version": self.version}
        out |= {"description": self.description} if self.description else {}
        out |= {"schema": {f.name: spec(f) for f in self.schema.fields}, "parser": self.parser, "model": self.model_name, "extraction_type": self.extraction_type, "extraction_mode": o.mode, "n_instances": o.instances}
        for key, value in (("schema_shards", o.shards if o.shards > 1 else None), ("temperatures", o.temperatures), ("context", o.context), ("normalize_output", o.normalize), ("validation", self.validation), ("review", [r for r in self.review if "llm_reviewer" not in r]), ("storage", {"type": "tables", "path": self.storage} if self.storage else None)):
            if value:
                out[key] = value
        return out

    def export_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.export(), sort_keys=False, allow_unicode=True)

    # --- steps ------------------------------------------------------------------------------

    def texts(self, docs: DataFrame) -> DataFrame:
        """Documents whose text a model may see: as the policy has it."""
        if self.policy is None:
            return docs
        pages = docs.select("doc_id", F.posexplode(F.split("text", "\\f")).alias("page", "text"))
        found = privacy.detect_by(pages, lambda: self.policy.providers or [default_provider(self.policy.entities)])
        hidden, self.tokens = privacy.anonymize_pages(pages, found, self.policy)
        safe = hidden.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\f").alias("safe"), F.first("blocked", ignorenulls=True).alias("blocked"))
        return docs.join(safe, "doc_id", "left").withColumn("text", F.coalesce("safe", "text")).drop("safe")

    def fields(self, docs: DataFrame) -> DataFrame:
        """The fields of each document, with evidence."""
        if self.model is None:
            raise InkstrataError("the engine has no model")
        out = extraction.extract(docs, self.schema, self.model, self.options)
        if "blocked" in docs.columns:
            out = out.join(docs.select("doc_id", "blocked"), "doc_id").withColumn("error", F.coalesce("blocked", "error")).withColumn("success", F.col("success") & F.col("blocked").isNull()).drop("blocked")
        composite = F.when(F.startswith("value", F.lit("[")) | F.startswith("value", F.lit("{")), F.col("value"))
        ev = locate.evidence(out.select("doc_id", "field", "value", composite.alias("composite"), "hint_text", "hint_page"), docs)
        has = ev.where("source <> 'unmatched' or text is not null").groupBy("doc_id", "field").agg(F.min_by(F.struct("source", "page", "text", "box", "confidence"), "seq").alias("evidence"))
        return out.join(has, ["doc_id", "field"], "left")

    def errors(self, fields: DataFrame) -> DataFrame:
        """doc_id, field, rule, message, severity, order of all validation rules."""
        none = "doc_id bigint, field string, rule string, message string, severity int, `order` int"
        out = fields.sparkSession.createDataFrame([], none)
        per = fields.groupBy("doc_id").agg(F.collect_list(F.struct("field", "value", F.col("evidence").isNotNull().alias("has"))).alias("f"))
        for n, rule in enumerate(self.validation):
            if "required_fields" in rule:
                each = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.when(~F.exists("f", lambda y: y["field"] == x), F.lit("field is missing")).when(~F.exists("f", lambda y: (y["field"] == x) & y["value"].isNotNull()), F.lit("value is null")).alias("message")) for x in rule["required_fields"]]))  # noqa: B023
                part = per.select("doc_id", each.alias("e")).select("doc_id", "e.field", F.lit("required_fields").alias("rule"), "e.message", F.lit(rules.ERROR).alias("severity"))
            elif "evidence_required" in rule:
                names = rule["evidence_required"] if isinstance(rule["evidence_required"], list) else []
                part = fields.where(F.col("value").isNotNull() & F.col("evidence").isNull() & (F.col("field").isin(*names) if names else F.lit(True))).select("doc_id", "field", F.lit("evidence_required").alias("rule"), F.lit("value without evidence").alias("message"), F.lit(rules.ERROR).alias("severity"))
            else:
                part = fields.where("value = ''").select("doc_id", "field", F.lit("type_validation").alias("rule"), F.lit("value is empty").alias("message"), F.lit(rules.WARNING).alias("severity"))
            out = out.unionByName(part.where("message is not null").withColumn("order", F.lit(n)))
        for n, rule in enumerate(self.custom_rules, len(self.validation)):
            out = out.unionByName(rule(fields).select("doc_id", "field", "rule", "message", "severity").withColumn("order", F.lit(n)))
        return out

    def _reasons(self, confidence: Column, fields: Column, errors: Column) -> list[Column]:
        out = []
        for rule in self.review:
            if "overall_confidence_below" in rule:
                out.append(rules.confidence_below(confidence, rule["overall_confidence_below"]))
            elif "field_confidence_below" in rule:
                out.append(rules.fields_untrusted(fields, rule["field_confidence_below"]))
            elif "any_field_confidence_below" in rule:
                out.append(rules.first_untrusted(fields))
            elif "has_validation_errors" in rule:
                out.append(rules.has_errors(errors))
            elif "field_missing" in rule:
                out.append(rules.critical_missing(fields, rule["field_missing"]))
            elif "no_evidence" in rule:
                out.append(rules.without_evidence(fields, rule["no_evidence"] if isinstance(rule["no_evidence"], list) else None))
        return out

    def results(self, fields: DataFrame, errors: DataFrame) -> DataFrame:
        """doc_id, success, error, confidence, consensus_score, n_errors, reasons, needs_review, status: one row for each document."""
        base = extraction.results(fields)
        arrays = fields.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field", "value", F.coalesce("gate", F.lit(False)).alias("gate"), F.col("evidence").isNotNull().alias("evidence")))), lambda x: x).alias("fields"))
        counts = errors.groupBy("doc_id").agg(F.count("*").alias("n_errors"))
        rows = base.join(arrays, "doc_id").join(counts, "doc_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
        held = self._reasons(F.col("confidence"), F.col("fields"), F.col("n_errors"))
        out = rules.review(rows, held) if held else rows.withColumn("reasons", F.array().cast("array<string>")).withColumn("needs_review", F.lit(False))
        return out.withColumn("status", F.lit("pending")).drop("fields")

    # --- the whole --------------------------------------------------------------------------

    def run(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(results, fields) of documents (doc_id, text and perhaps page_texts).

        A document whose text the policy blocked, or whose answer failed, has its error and null values; nothing else fails.
        """
        safe = self.texts(docs)
        fields = extraction.kept(self.fields(safe))
        errors = self.errors(fields)
        found = fields.join(errors.groupBy("doc_id", "field").agg(F.max("severity").alias("worst"), F.transform(F.array_sort(F.collect_list(F.struct("order", "message"))), lambda x: x["message"]).alias("messages")), ["doc_id", "field"], "left")
        status = F.when(F.col("worst") == rules.ERROR, "error").when(F.col("worst") == rules.WARNING, "warning").otherwise("valid")
        found = found.withColumn("validation", status).withColumn("messages", F.coalesce("messages", F.array().cast("array<string>"))).drop("worst")
        results = self.results(fields, errors)
        if self.storage:
            store = Store(docs.sparkSession, self.storage)
            store.save("result", results)
            if self.policy and self.policy.reversible:
                store.save("mapping", self.tokens)
        return results, found

    def auto(self, docs: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Text extraction, and for documents with too little text the seeing model on their page images; never with a policy."""
        if self.policy is not None or pages is None or self.look is None:
            return self.run(docs)
        chars = F.length(F.trim(F.coalesce("text", F.lit(""))))
        n = F.greatest(F.size(dm.pages_of(F.col("text"))), F.lit(1))
        none = F.lit(None).cast("double")
        told = docs.withColumn("why", dm.escalation(chars, n, docs["ocr_score"] if "ocr_score" in docs.columns else none, docs["low_share"] if "low_share" in docs.columns else none))
        results, fields = self.run(told.where("why is null").drop("why"))
        escalated = told.where("why is not null").select("doc_id", "why")
        seen = extraction.see(pages.join(escalated.select("doc_id"), "doc_id", "left_semi"), self.schema, self.look, self.options)
        more = extraction.results(seen).join(escalated, "doc_id")
        wide = results.withColumn("escalation", F.lit(None).cast("string")).unionByName(more.withColumnRenamed("why", "escalation"), allowMissingColumns=True)
        return wide, fields.unionByName(seen, allowMissingColumns=True)


def provider(spec: dict | str) -> Callable:
    """A provider of findings from its configuration: ``patterns`` (what is built in) or ``dictionary``."""
    if spec in ("patterns", "presidio") or isinstance(spec, dict) and spec.get("type", "patterns") in ("patterns", "presidio"):
        return default_provider()
    if isinstance(spec, dict) and spec.get("type") == "dictionary":
        kind = privacy.PatternTerms if spec.get("regex") else privacy.LiteralTerms
        return kind(spec.get("mask"), spec.get("replacements"), spec.get("case_sensitive", True))
    raise PrivacyError(f"unknown provider {spec!r}")


def default_provider(entities: tuple[str, ...] | None = None) -> Callable:
    """The patterns of ``operators.privacy`` for the entities asked for."""
    own = {p: e for e, p in privacy.PATTERNS.items() if entities is None or e in entities}
    return privacy.PatternTerms(own or {p: e for e, p in privacy.PATTERNS.items()})


# --- facades --------------------------------------------------------------------------------


def documents_of(spark: SparkSession, path: str, pattern: str = "*", reader: Callable | None = None) -> DataFrame:
    """doc_id, path, kind, text of the files under a path; files of unknown kind are an error, those that need a reader go through ``reader``."""
    rows = files.read_files(spark, path, pattern)
    odd = rows.where("kind = 'unknown'").select("path").limit(1).first()
    if odd is not None:
        raise UnsupportedFileType(odd[0])
    text = files.read_texts(spark, path) if pattern == "*" else files.read_texts(spark, path).join(rows.select("doc_id"), "doc_id", "left_semi")
    plain = text.join(rows.select("doc_id", "kind", "content_hash"), "doc_id")
    other = rows.where("kind not in ('text', 'html', 'email')")
    if reader is None:
        missing = other.select("path").limit(1).first()
        if missing is not None:
            raise UnsupportedFileType(f"{missing[0]} needs a reader")
        return plain
    read = parsing.read_pages(other, reader)
    joined = read.where("error is null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\f").alias("text"))
    return plain.unionByName(other.select("doc_id", "path", "kind", "content_hash").join(joined, "doc_id", "left").select("doc_id", "path", "text", "kind", "content_hash"))


def extract(spark: SparkSession, path: str, schema: sc.Schema | str, model: Callable, reader: Callable | None = None, **options) -> dict:
    """The result of one file as a mapping: document, data, fields, confidence, success, error."""
    own = sc.Registry().load(schema) if isinstance(schema, str) else schema
    results, fields = Engine(own, model, options=extraction.Options(**options)).run(documents_of(spark, path, reader=reader))
    r = results.limit(2).toLocalIterator()
    rows = [x.asDict(recursive=True) for x in r]
    if len(rows) != 1:
        raise InkstrataError(f"{path} is {len(rows)} documents; use process_batch")
    own_fields = {f["field"]: f for f in (x.asDict(recursive=True) for x in fields.orderBy("pos").toLocalIterator())}
    return rows[0] | {"schema": own.name, "data": {n: f["value"] for n, f in own_fields.items()}, "fields": own_fields}


def run_workflow(spark: SparkSession, config: dict | str | Path, path: str, model: Callable, reader: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    return Engine.from_config(config, model).run(documents_of(spark, path, reader=reader))


def process_batch(docs: DataFrame, engine: Engine) -> dict[str, DataFrame]:
    """report, reasons, documents (wide, one column for each field), names of any number of documents."""
    results, fields = engine.run(docs)
    results = extraction.kept(results)
    named = docs.select("doc_id", (base_name(F.col("path")) if "path" in docs.columns else F.col("doc_id").cast("string")).alias("file_name"))
    wide = fields.groupBy("doc_id").pivot("field", engine.schema.names).agg(F.first("value"))
    documents = named.join(results.select("doc_id", "success", "confidence", "needs_review", "error"), "doc_id").join(wide, "doc_id", "left")
    report = reports.batch(results.withColumn("approved", ~F.col("needs_review")))
    return {"report": report, "reasons": reports.top_reasons(results.where("success and needs_review"), "doc_id"), "documents": documents, "names": reports.names_in_order(fields, ["doc_id", "pos"]), "fields": fields, "results": results}


def compare_documents(docs: DataFrame, engine: Engine) -> DataFrame:
    """How documents differ, field by field; those whose extraction failed are left out."""
    results, fields = engine.run(docs)
    good = results.where("success").select("doc_id").withColumn("order", F.col("doc_id"))
    return reports.differences(fields.join(good.select("doc_id"), "doc_id", "left_semi"), good, "order")


def discover_schema(text: str, model: Callable[[], Callable]) -> tuple[sc.Schema, str]:
    """A schema for documents like a sample, and its template, by a model; the first 8,000 characters are shown."""
    ask = "Which fields could be taken from documents like this one? Answer with JSON: document_type, description, fields (name, type of str, int, float, bool, date or list[str], required, description).\n\n" + text[:8000]
    answer = model()([ask])[0]
    if not answer:
        raise SchemaError("the model gave no answer")
    return sc.discovered(answer)


def verification_queue(fields: DataFrame) -> DataFrame:
    """Fields of results that want a second reading, at most ``MAX_FIELDS`` of a document."""
    from inkstrata.operators import verification

    rows = fields.select("doc_id", "field", "pos", "value", F.coalesce("consensus", F.lit(1.0)).alias("consensus"), "found")
    return verification.queue(rows, MAX_FIELDS)


__all__ = ["Engine", "compare_documents", "discover_schema", "documents_of", "extract", "process_batch", "provider", "run_workflow", "verification_queue", "MIN_CONSENSUS"]
