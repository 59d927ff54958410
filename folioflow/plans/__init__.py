"""Registered queries; importing this package registers all of them."""

from folioflow.plans import detail_queries, feed_queries, search_queries, store_queries, text_queries, usage_queries
from folioflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "detail_queries", "feed_queries", "search_queries", "store_queries", "text_queries", "usage_queries"]
