"""All queries for the library's own operators, and their SQL."""

from sparkbooks.plans import attribution_queries, layer_queries, production_queries, proposal_queries, segment_queries, stats_queries, stream_queries, structure_queries  # noqa: F401
from sparkbooks.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
