"""All registered queries of the engine."""

from . import queries_graphs, queries_plans  # noqa: F401  add their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
