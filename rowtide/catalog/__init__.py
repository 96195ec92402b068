"""All registered queries."""

import importlib

from rowtide.catalog.registry import QUERIES, Tables

for _part in ("reads", "joins", "aggregates", "sources", "writes", "scalars", "messages", "streams", "changes", "shapes",
              "contracts", "access", "computations", "schedules", "evolution"):
    importlib.import_module(f"rowtide.catalog.{_part}")

__all__ = ["QUERIES", "Tables"]
