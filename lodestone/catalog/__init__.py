"""The registered queries: each operator over the given tables, with its SQL where there is one."""

from __future__ import annotations

from lodestone.catalog import indexing, log, quality, routing, searching, sources, texts  # noqa: F401
from lodestone.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
