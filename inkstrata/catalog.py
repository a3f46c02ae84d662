"""All queries of the library and the SQL that checks them."""

from inkstrata.plans import document_queries, engine_queries, field_queries, layout_queries, privacy_queries, report_queries, rows_queries  # noqa: F401
from inkstrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
