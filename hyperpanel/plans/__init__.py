"""All registered queries."""

from . import analysis_queries, graph_queries, more_queries, panel_queries, source_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
