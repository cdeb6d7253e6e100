"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from factloom.plans import corpus, drawings, geometry, relations, reviews, texts  # noqa: F401
from factloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
