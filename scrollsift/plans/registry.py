"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from scrollsift.plans import capture, entity, filters, search, store

MODULES = (filters, entity, store, search, capture)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "filter_pipeline"
