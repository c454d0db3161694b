"""All queries and their SQL."""

from gridloom.plans import audit_queries, contract_queries, governance_queries, metric_queries, panel_queries, source_queries, stored_queries, stream_queries, tree_queries, user_queries  # noqa: F401
from gridloom.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
