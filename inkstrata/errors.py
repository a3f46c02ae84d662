"""What can go wrong, as exceptions of one family."""

from __future__ import annotations


class InkstrataError(Exception):
    """The base of all errors of this package."""


class UnsupportedFileType(InkstrataError):
    """No source is known for a file's ending or type."""


class ParsingError(InkstrataError):
    """A document could not be parsed."""


class OcrError(InkstrataError):
    """Text recognition failed."""


OcrFailed = OcrError


class SchemaError(InkstrataError):
    """An answer does not fit the schema, or the schema is none."""


class FieldInvalid(InkstrataError):
    """A field broke a validation rule."""

    def __init__(self, message: str, field: str | None = None, rule: str | None = None):
        super().__init__(message)
        self.field, self.rule = field, rule


class EvidenceMissing(InkstrataError):
    """A value has no support in its document."""


class StoreError(InkstrataError):
    """A result could not be kept or read."""


class WorkflowError(InkstrataError):
    """A workflow stopped; ``result`` is what there was by then."""

    def __init__(self, message: str, result: object | None = None):
        super().__init__(message)
        self.result = result


class ReviewNeeded(InkstrataError):
    """A person has to look at a document first."""

    def __init__(self, message: str, document: object | None = None, reason: str | None = None):
        super().__init__(message)
        self.document, self.reason = document, reason


ReviewRequired = ReviewNeeded


class PrivacyError(InkstrataError):
    """A privacy policy contradicts itself or was broken."""


class AnonymizationFailed(PrivacyError):
    """Detection or replacement failed and the policy does not let the text through."""
