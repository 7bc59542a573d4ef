"""All registered queries of the library."""

from __future__ import annotations

from .plans import chains, clusters, joins, prep, reports  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
