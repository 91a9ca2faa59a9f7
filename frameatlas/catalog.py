"""All queries of the core by name, each with its SQL where SQL can state it."""

from __future__ import annotations

import importlib

from frameatlas.operators import orphan_queries
from frameatlas.plans import cohesion, registry

for _name in ("cohorts", "aggregates", "rankings", "scalars", "clustering", "texts", "reports", "feeds", "stages"):
    try:
        importlib.import_module(f"frameatlas.plans.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"frameatlas.plans.{_name}":
            raise

QUERIES = {**cohesion.QUERIES, **registry.QUERIES, **orphan_queries.QUERIES}
SQL = {**cohesion.SQL, **registry.SQL, **orphan_queries.SQL}
COVERS = {"cohesion_by_cluster": ["R2", "A6", "A7", "W1"], **registry.COVERS}
