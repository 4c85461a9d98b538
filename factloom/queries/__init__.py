"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from factloom.queries.base import QUERIES, SQL
from factloom.queries import aggregates, anchors, blocks, catalog, constraints, contracts, display, documents, extraction, joins, retrieval, rules, sessions, similar, slots, stores, support, tables, text, windows  # noqa: F401  (they register themselves)

__all__ = ["QUERIES", "SQL"]
