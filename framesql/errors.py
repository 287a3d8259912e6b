"""Errors that the library raises."""


class FrameSqlError(Exception):
    """Base of all errors of this library."""


class ExecuteError(FrameSqlError):
    """A query could not be registered, parsed or analysed; the cause is attached."""


class UnsupportedError(FrameSqlError):
    """The request names something that the library does not know."""
