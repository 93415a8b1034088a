"""All queries of the engine's own operators, with their oracle SQL."""

from __future__ import annotations

from lexiforge.plans import corpus_queries, evidence_queries, relational_queries, search_queries, stream_queries, text_queries  # noqa: F401
from lexiforge.plans.query import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
