"""Errors of builders and terminals. Every builder error is raised before a Spark job starts."""


class SparkloomError(Exception):
    pass


class ModelError(SparkloomError, ValueError):
    """A declaration that contradicts itself."""


class BuildError(SparkloomError, ValueError):
    """A query that can't be compiled."""


class NoRows(SparkloomError, LookupError):
    pass


class MultipleRows(SparkloomError, LookupError):
    pass


class DuplicateKey(SparkloomError, ValueError):
    pass


class Conflict(SparkloomError, RuntimeError):
    """Another writer has changed what a transaction read."""
