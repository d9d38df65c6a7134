"""All registered queries of the library proper."""

from winnower.plans import aggregates, lifecycle, results, rules, scores, similarity, sources, streams, windows  # noqa: F401  each import registers its queries
from winnower.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
