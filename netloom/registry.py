"""Every registered query with its SQL twin."""

from __future__ import annotations

from netloom.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
