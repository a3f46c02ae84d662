"""The engine's operations as named tools that take plain values and give JSON texts, for agents and scripts.

``Tools`` holds a session, the models and a store; ``call`` runs a tool by name,
and an error is part of the answer. Every tool is one of the engine's operations
over a table, of a single document where it names one.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkstrata import engine as en
from inkstrata.errors import StoreError
from inkstrata.operators import extraction, filling, locate, routing
from inkstrata.operators import schema as sc
from inkstrata.sources import files, metadata
from inkstrata.sources.store import Store


def _json(value: Any) -> str:
    return json.dumps(value, default=str, ensure_ascii=False)


class Tools:
    def __init__(self, spark: SparkSession, model: Callable | None = None, look: Callable | None = None, store: str | None = None, reader: Callable | None = None, screens: Callable | None = None):
        self.spark, self.model, self.look, self.reader, self.screens = spark, model, look, reader, screens
        self.store = Store(spark, store) if store else None

    def call(self, name: str, **arguments) -> str:
        """A tool's answer; what goes wrong is its ``error``."""
        try:
            if name.startswith("_") or name in ("call", "names") or not hasattr(self, name):
                raise ValueError(f"unknown tool {name}")
            return getattr(self, name)(**arguments)
        except Exception as e:  # noqa: BLE001 - a tool's failure is its answer
            return _json({"error": f"{type(e).__name__}: {e}"})

    @classmethod
    def names(cls) -> dict[str, list[str]]:
        """Every tool and its parameters."""
        return {n: list(inspect.signature(f).parameters)[1:] for n, f in vars(cls).items() if callable(f) and not n.startswith("_") and n not in ("call", "names")}

    def _stored(self) -> Store:
        if self.store is None:
            raise StoreError("no store is named")
        return self.store

    # --- extraction -------------------------------------------------------------------------

    def extract_document(self, file_path: str, schema_name: str = "invoice", extraction_mode: str = "single", n_instances: int = 5, context: str = "") -> str:
        return _json(en.extract(self.spark, file_path, schema_name, self.model, self.reader, mode=extraction_mode, instances=n_instances, context=context))

    def extract_with_vision(self, file_path: str, schema_name: str = "invoice") -> str:
        """By the model that sees pictures; ``screens`` gives a file's pages as base64 images."""
        rows = [(0, n, image) for n, image in enumerate(self.screens(file_path))]
        pages = self.spark.createDataFrame(rows, "doc_id long, page int, image string")
        fields = extraction.see(pages, sc.Registry().load(schema_name), self.look)
        return _json({"fields": [r.asDict(recursive=True) for r in fields.orderBy("pos").toLocalIterator()]})

    def discover_schema(self, file_path: str) -> str:
        text = en.documents_of(self.spark, file_path, reader=self.reader).select("text").first()[0]
        schema, template = en.discover_schema(text or "", self.model)
        return _json({"name": schema.name, "fields": schema.names, "template": template})

    def compare_documents(self, folder_path: str, schema_name: str = "invoice", pattern: str = "*") -> str:
        docs = en.documents_of(self.spark, folder_path, pattern, self.reader)
        rows = en.compare_documents(docs, en.Engine(sc.Registry().load(schema_name), self.model))
        return _json({"differences": [r.asDict(recursive=True) for r in rows.toLocalIterator()]})

    def process_batch(self, folder_path: str, schema_name: str = "invoice", pattern: str = "*", output: str | None = None) -> str:
        """The report of a folder; the table of its documents goes to ``output`` as CSV."""
        made = en.process_batch(en.documents_of(self.spark, folder_path, pattern, self.reader), en.Engine(sc.Registry().load(schema_name), self.model))
        if output:
            made["documents"].write.mode("overwrite").option("header", True).csv(output)
        return _json({"report": made["report"].first().asDict(), "reasons": {r["reason"]: r["count"] for r in made["reasons"].toLocalIterator()}})

    def list_templates(self) -> str:
        return _json({"templates": sc.Registry().list()})

    def show_template(self, name: str) -> str:
        return _json(sc.Registry().raw(name))

    def search_in_document(self, file_path: str, query: str, fuzzy: bool = False) -> str:
        docs = en.documents_of(self.spark, file_path, reader=self.reader)
        hits = [r.asDict(recursive=True) for r in locate.search_document(docs.select("doc_id", "text"), [query], fuzzy=fuzzy).toLocalIterator()]
        return _json({"query": query, "total_hits": len(hits), "hits": hits})

    # --- results ----------------------------------------------------------------------------

    def get_pending_reviews(self) -> str:
        rows = self._stored().load("result")
        ids = [] if rows is None else [r[0] for r in rows.where("needs_review and status = 'pending'").select("doc_id").orderBy("doc_id").toLocalIterator()]
        return _json({"pending": ids})

    def get_extraction_result(self, document_id: int) -> str:
        return _json(self._found("result", document_id))

    def _found(self, kind: str, document_id: int) -> dict:
        row = self._stored().get(kind, document_id)
        if row is None:
            raise StoreError(f"there is no {kind} of {document_id}")
        return row

    def _changed(self, kind: str, row: dict) -> str:
        schema = self._stored().load(kind).schema
        self._stored().save(kind, self.spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema))
        return _json(row)

    def correct_field(self, document_id: int, field_name: str, new_value: str, corrected_by: str = "", reason: str = "") -> str:
        """Writes a correction: the value, and the log's entry in ``corrections``."""
        row = self._found("result", document_id)
        fields = row["fields"]
        if field_name not in fields:
            raise KeyError(f"there is no field {field_name}")
        log = (row.get("corrections") or []) + [{"field": field_name, "old_value": fields[field_name], "new_value": new_value, "by": corrected_by, "reason": reason}]
        return self._changed("result", row | {"fields": fields | {field_name: new_value}, "corrections": log})

    def _decided(self, kind: str, document_id: int, status: str, by: str, reason: str) -> str:
        row = self._found(kind, document_id)
        if row["status"] in ("approved", "rejected"):
            raise ValueError(f"the document is {row['status']} already")
        return self._changed(kind, row | {"status": status, "reviewed_by": by, "rejection_reason": reason})

    def approve_document(self, document_id: int, approved_by: str = "") -> str:
        return self._decided("result", document_id, "approved", approved_by, "")

    def reject_document(self, document_id: int, rejected_by: str = "", reason: str = "") -> str:
        return self._decided("result", document_id, "rejected", rejected_by, reason)

    # --- fills ------------------------------------------------------------------------------

    def get_pending_fills(self) -> str:
        rows = self._stored().load("filling")
        ids = [] if rows is None else [r[0] for r in rows.where("needs_review and status = 'pending' and not committed").select("doc_id").orderBy("doc_id").toLocalIterator()]
        return _json({"pending": ids})

    def edit_fill_field(self, document_id: int, field_name: str, new_value: str, corrected_by: str = "", reason: str = "") -> str:
        row = self._found("filling", document_id)
        if row["committed"]:
            raise ValueError("the fill is committed")
        if row["status"] == "rejected":
            raise ValueError("the fill is rejected")
        if field_name not in row["values"]:
            raise KeyError(f"there is no field {field_name}")
        return self._changed("filling", row | {"values": row["values"] | {field_name: new_value}})

    def approve_fill(self, document_id: int, approved_by: str = "", commit: bool = True) -> str:
        answer = self._decided("filling", document_id, "approved", approved_by, "")
        if not commit:
            return answer
        row = self._found("filling", document_id)
        warnings = self._write(row)
        return self._changed("filling", row | {"committed": True, "warnings": warnings})

    def reject_fill(self, document_id: int, rejected_by: str = "", reason: str = "") -> str:
        return self._decided("filling", document_id, "rejected", rejected_by, reason)

    def _write(self, row: dict) -> list[str]:
        content, warnings = filling.fill_docx(Path(row["input_path"]).read_bytes(), row["values"], row["flatten"])
        Path(row["output_path"]).write_bytes(content)
        return warnings

    def fill_docx_form(self, file_path: str, data: dict[str, Any], output_path: str = "", flatten: bool = False, review: bool = False, document_id: int = 0) -> str:
        """Fills a Word form, or plans it for review and keeps the plan in the store."""
        controls = filling.docx_controls(Path(file_path).read_bytes())
        given = filling.data_fields(None, data)
        fields = self.spark.createDataFrame([(document_id, *(g[k] for k in ("field", "pos", "value", "kind", "aliases", "description", "mapped"))) for g in given], filling.FIELD_SCHEMA)
        targets = self.spark.createDataFrame([(document_id, n, k, o) for n, k, o, _ in controls], "doc_id long, target string, control string, options array<string>")
        plan = [r.asDict() for r in filling.docx_plan(fields, targets).orderBy("pos").toLocalIterator()]
        values = {p["target"]: p["text"] for p in plan if p["target"]}
        lost = [p["field"] for p in plan if not p["target"]]
        out = output_path or str(Path(file_path).with_name(f"{Path(file_path).stem}-filled{Path(file_path).suffix}"))
        row = {"doc_id": document_id, "input_path": file_path, "output_path": out, "values": values, "unmapped": lost, "flatten": flatten, "needs_review": review and bool(lost), "status": "pending", "reviewed_by": "", "rejection_reason": "", "committed": False, "warnings": []}
        if not values:
            return _json(row | {"error": "no control was given a value"})
        if review:
            schema = "doc_id long, input_path string, output_path string, `values` map<string, string>, unmapped array<string>, flatten boolean, needs_review boolean, status string, reviewed_by string, rejection_reason string, committed boolean, warnings array<string>"
            self._stored().save("filling", self.spark.createDataFrame([tuple(row.values())], schema))
            return _json(row)
        return _json(row | {"warnings": self._write(row), "committed": True})

    # --- documents --------------------------------------------------------------------------

    def split_document(self, file_path: str, sections: dict[str, str], deep: bool = False, allow_overlap: bool = True, split_rules: str = "", pages: list[int] | None = None) -> str:
        docs = en.documents_of(self.spark, file_path, reader=self.reader)
        rows = docs.select("doc_id", F.posexplode(F.split("text", "\\f")).alias("page", "text"))
        rows = rows.where(F.col("page").isin(*pages)) if pages else rows
        made = routing.split_documents(rows, sections, self.model, overlap=allow_overlap, rules=split_rules, deep=deep)
        return _json({"sections": {r["section"]: {"pages": r["pages"], "confidence": r["confidence"], "evidence": r["evidence"], "warning": r["warning"]} for r in made.toLocalIterator()}})

    def extract_document_metadata(self, file_path: str) -> str:
        rows = metadata.read_metadata(files.read_files(self.spark, file_path))
        return _json({"metadata": [r.asDict() for r in rows.where("kind is null or kind <> 'paragraph'").toLocalIterator()]})

    def screenshot_document(self, file_path: str, output_dir: str, pages: list[int] | None = None) -> str:
        """The pages' images, which ``screens`` renders, as files."""
        import base64

        out = []
        Path(output_dir).mkdir(parents=True, exist_ok=True)
        for n, image in enumerate(self.screens(file_path)):
            if pages is None or n in pages:
                path = Path(output_dir) / f"{Path(file_path).stem}_page_{n}.png"
                path.write_bytes(base64.b64decode(image))
                out.append({"page": n, "path": str(path)})
        return _json({"screenshots": out})
