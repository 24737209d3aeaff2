"""All queries over the core operators, with their SQL."""

from __future__ import annotations

from pairloom.plans import audits, base, cleaning, contracts, decontam, extensions, layout, ranking, streams, texts, vectors  # noqa: F401

QUERIES: dict = base.QUERIES
SQL: dict = base.SQL
