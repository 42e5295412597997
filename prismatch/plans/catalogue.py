"""All registered queries."""

from prismatch.plans import corpus_queries, event_queries, feature_queries, manifest_queries, retrieval_queries, service_queries  # noqa: F401
from prismatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
