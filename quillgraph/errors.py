"""What can go wrong, by cause."""

from __future__ import annotations


class QuillError(Exception):
    """Any error that this package raises on purpose."""


class ConfigurationError(QuillError):
    """A setting or a lexicon that cannot be used as it is."""


class ModelUnavailableError(QuillError):
    """A parser or model of a backend cannot be loaded."""


class CorpusError(QuillError):
    """The folder is missing, or nothing in it has text."""


class ExtractionError(QuillError):
    """Relations cannot be extracted from what a backend gave."""


class QueryError(QuillError):
    """A question cannot be run."""
