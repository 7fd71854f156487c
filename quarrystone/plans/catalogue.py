"""The catalogue queries and their SQL, by name."""

from __future__ import annotations

from quarrystone.plans import admin, attempts, cleaning, discovery, documents, extraction, gates, lifecycle, mentions, pages, profiles, public, published, quality, rates, records, retention, review, sources, supplements, validation  # noqa: F401
from quarrystone.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
