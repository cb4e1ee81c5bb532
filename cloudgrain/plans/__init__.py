"""Registered queries: each one a Spark plan with the SQL that must give the same rows."""

from . import basics, chunked, learned, streamed, tracked  # noqa: F401  (register on import)
from .registry import ORACLES, QUERIES  # noqa: F401
