"""Exact token costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COST = "decimal(12,6)"
_MILLIONTH = "decimal(7,6)"


def unrounded_cost(tokens: Column, price: Column) -> Column:
    """Tokens times the price of a million; no price costs nothing."""
    return F.coalesce(tokens.cast("decimal(18,0)") * price.cast("decimal(10,6)") * F.lit("0.000001").cast(_MILLIONTH), F.lit(0).cast("decimal(35,12)"))


def cost(tokens: Column, price: Column) -> Column:
    return unrounded_cost(tokens, price).cast(COST)
