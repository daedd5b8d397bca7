"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from foliospark.plans.catalogue.registry import QUERIES, SQL
from foliospark.plans.catalogue import corpus, graphs, models, scores, vectors  # noqa: F401  (registers)

__all__ = ["QUERIES", "SQL"]
