"""All registered queries."""

from weftgraph.suite import function_queries, graph_queries, other_queries, relational_queries, search_queries  # noqa: F401
from weftgraph.suite.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
