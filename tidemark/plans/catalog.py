"""All registered queries, by importing the modules that register them."""

from tidemark.plans import aggregate_queries, ingest_queries, pipeline_queries, scalar_queries, search_queries, streaming_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
