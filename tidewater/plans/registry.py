"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tidewater.plans import fact_queries, graph_queries

QUERIES: dict = graph_queries.QUERIES | fact_queries.QUERIES
ORACLES: dict[str, str] = graph_queries.ORACLES | fact_queries.ORACLES
