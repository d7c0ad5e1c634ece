"""All registered queries: importing the modules fills the catalogue."""

from __future__ import annotations

from postmill.plans import cars, catalog, drafts, enrich, feeds, health, lifecycle, listings, reads, searches, stores, texts  # noqa: F401

QUERIES, SQL = catalog.QUERIES, catalog.SQL
