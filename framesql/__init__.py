"""SQL and DataFrame analytics on Spark: one ``execute`` call over frames, rows and files."""

from framesql.api import execute
from framesql.errors import ExecuteError, FrameSqlError, UnsupportedError

__all__ = ["ExecuteError", "FrameSqlError", "UnsupportedError", "execute"]
__version__ = "0.1.0"
