"""All registered queries."""

from __future__ import annotations

from cuespan.plans import ingest_queries, match_queries, segment_queries, stream_queries, table_queries, timeline_queries  # noqa: F401
from cuespan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
