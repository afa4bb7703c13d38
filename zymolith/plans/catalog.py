"""All registered queries and their SQL."""

from __future__ import annotations

from . import evaluation, files, joining, models, preparation, records, structures  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
