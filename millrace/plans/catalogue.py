"""All queries with their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import aggregate_queries, families, relational, scalars, storage
from .book import Query

BOOKS = [relational.BOOK, scalars.BOOK, families.BOOK, aggregate_queries.BOOK, storage.BOOK]


def queries() -> dict[str, Query]:
    return {n: q for b in BOOKS for n, q in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for b in BOOKS for n, s in b.sql.items()}
