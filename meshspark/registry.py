"""All queries of the library proper by name, with their SQL."""

from __future__ import annotations

from .plans import charts, graphs, linear, meshes, metrics, relational  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
