"""Loads every query module so that all queries are registered."""

from jobatlas.catalog import market_queries, pipeline_queries, ranking_queries, reuse_queries, session_queries, text_queries  # noqa: F401
from jobatlas.catalog.base import ORACLES, QUERIES  # noqa: F401
