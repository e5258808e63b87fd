"""All queries over the tables of the relational and text engine."""

from __future__ import annotations

from . import functional, relational, statements, textual  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
