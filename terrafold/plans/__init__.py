"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from . import core, entries, files, further, more, values  # noqa: F401
from .domain import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
