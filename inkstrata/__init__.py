"""Document analytics and training-data pipelines on Spark; names are imported when they are first used."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "inkstrata.engine": ("Engine", "extract", "run_workflow", "process_batch", "compare_documents", "discover_schema", "documents_of"),
    "inkstrata.operators.schema": ("Field", "Schema", "Registry", "schema_of"),
    "inkstrata.operators.privacy": ("Policy", "PatternTerms", "LiteralTerms"),
    "inkstrata.operators.routing": ("Router", "split_documents"),
    "inkstrata.operators.extraction": ("Options",),
    "inkstrata.operators.filling": ("acroform_plan", "overlay_plan", "docx_plan", "fill_docx", "fold_log", "preview_boxes"),
    "inkstrata.operators.reports": ("quality", "evaluate", "highlight_rects"),
    "inkstrata.operators.locate": ("search_document", "evidence"),
    "inkstrata.sources.store": ("Store",),
    "inkstrata.sources.metadata": ("read_metadata",),
    "inkstrata.errors": ("InkstrataError",),
}
_NAMES = {n: m for m, names in _WHERE.items() for n in names}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"inkstrata has no {name}")
    return getattr(import_module(_NAMES[name]), name)


def __dir__() -> list[str]:
    return __all__
