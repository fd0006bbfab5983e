"""Column expressions over embeddings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine (0 for a zero vector), dot, or 1 less the squared distance (l2)."""
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def score_of(a: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """``score`` against a fixed vector, whose norm is computed once."""
    if metric != "cosine":
        return score(a, literal(query), metric)
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    return F.coalesce(dot(a, literal(query)) / F.nullif(F.sqrt(dot(a, a)) * F.lit(norm), F.lit(0.0)), F.lit(0.0))


def distance(s: Column) -> Column:
    return F.when(s <= 1, 1 - s).otherwise(0.0)
