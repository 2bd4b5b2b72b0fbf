"""The queries of the library, by name, and DuckDB SQL for them."""

from __future__ import annotations

from .plans import details, landed, measures, offices, registers, shapes  # noqa: F401  (its queries register themselves)
from .plans.queries import QUERIES, SQL

FLAGSHIP = "case_workload"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
