"""Named queries of the library and their DuckDB twins, gathered from the plans."""

from __future__ import annotations

from wayfind.plans import behaviour_queries, catalogue_queries, ingest_queries, search_queries  # noqa: F401
from wayfind.plans.registry import QUERIES, SQL

FLAGSHIP = "covis_neighbors_basket"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
