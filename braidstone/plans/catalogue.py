"""The queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from braidstone.plans import cycle_queries, sync_queries, text_queries, vector_queries

QUERIES = text_queries.QUERIES | vector_queries.QUERIES | sync_queries.QUERIES | cycle_queries.QUERIES
ORACLES = text_queries.ORACLES | vector_queries.ORACLES | sync_queries.ORACLES | cycle_queries.ORACLES
