"""All queries of the library outside the text-preparation subpackage, by name."""

from __future__ import annotations

from fiscalis.plans import audit, exchange, forms, handoffs, money, pages, records, registry, shapes, stored  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
