"""Expressions over numeric arrays, kept in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit length; an all-zero row stays as it is.

    The norm is bound by the outer transform, so it is worked out once per row, not per element.
    """
    scaled = F.transform(
        F.array(l2_norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    )
    return F.get(scaled, F.lit(0))


def concat_views(*views: Column) -> Column:
    """Unit vectors of several views side by side, brought back to unit length."""
    return l2_normalise(F.concat(*views))


def argmax(scores: Column) -> Column:
    """Zero-based place of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
