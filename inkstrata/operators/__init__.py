"""Operators over DataFrames of documents, fields and findings."""
