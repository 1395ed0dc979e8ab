"""Errors raised by the engine."""


class SearchError(Exception):
    """Base of every error the engine raises on purpose."""


class IndexIOError(SearchError):
    """An index directory is missing, foreign, or may not be written."""


class QueryError(SearchError):
    """A call's arguments cannot be carried out."""
