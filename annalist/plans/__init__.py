"""The registered queries."""

from annalist.plans import code, knowledge, queries, retrieval
from annalist.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "code", "knowledge", "queries", "retrieval"]
