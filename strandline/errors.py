"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class TableNotFound(EngineError):
    """The table does not exist."""


class TableExists(EngineError):
    """A table of that name exists already."""


class DatabaseClosed(EngineError):
    """The database was closed."""


class TagNotFound(EngineError):
    """The tag was never written to the table."""


class NoDataForTag(EngineError):
    """The tag is known but has no data (left)."""


class TimestampOutOfRange(EngineError):
    """A time further in the future than the guard allows."""


class EmptyValue(EngineError):
    """A value that is empty (null)."""


class UnsupportedFloat(EngineError):
    """NaN or infinite."""


class TypeMismatch(EngineError):
    """A value that cannot be converted to its column's type."""


class LateRecord(EngineError):
    """Older than the last kept record of its tag."""


class InvalidPredicate(EngineError):
    """An empty list, unknown operator or wrong type in a predicate tree."""


class ColumnNotFound(EngineError):
    """A path that a value does not have."""
