"""Names of the queries of the core engine, with their SQL counterparts."""

from __future__ import annotations

from .plans import books, catalogue, driver, hybrid, inputs, writes  # noqa: F401  (they add their queries)
from .plans.core import ORACLE_SQL, QUERIES

FLAGSHIP = "structural_candidates"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
