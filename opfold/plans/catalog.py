"""All queries and their SQL oracles."""

from opfold.plans import access_queries, cluster_queries, log_queries, stream_queries
from opfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "access_queries", "cluster_queries", "log_queries", "stream_queries"]
