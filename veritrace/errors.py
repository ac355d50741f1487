"""Errors, each with whether trying again may help."""

from __future__ import annotations


class ScreeningError(Exception):
    retryable = False


class InvalidArgument(ScreeningError, ValueError):
    """An argument that no retry mends."""


class QueryError(InvalidArgument):
    """A query that can't be screened."""


class ParseError(ScreeningError):
    """A payload that is not what its source publishes."""


class MalformedDocument(ParseError):
    """A document that is cut off or broken; no part of it is used."""


class SourceError(ScreeningError):
    """A source that can't be had now."""

    retryable = True


class StorageError(ScreeningError):
    pass


class MissingSnapshot(StorageError):
    pass


class CorruptSnapshot(StorageError):
    """Stored rows that don't give the checksum that they were stored under."""


class UnsupportedSchema(StorageError):
    pass


class IntegrityError(ScreeningError):
    """A bundle or payload whose signature or checksum is not its content's."""
