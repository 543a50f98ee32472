"""Check queries: one or more per inventory item, each with its oracle statement."""

from . import analytics, catalogs, rows, streams  # noqa: F401  (they register on import)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
