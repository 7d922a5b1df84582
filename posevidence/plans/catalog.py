"""All registered queries."""

from posevidence.plans import audit_queries, compare_queries, drift_queries, extract_queries, shape_queries, stream_queries, track_queries  # noqa: F401
from posevidence.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
