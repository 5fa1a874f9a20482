"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def half_even_share(count: Column, fraction: float) -> Column:
    """``fraction`` of a count, rounded half to even."""
    return F.bround(count * F.lit(float(fraction)), 0).cast("long")


def seeded_order(column: Column, seed: int) -> Column:
    """A portable pseudo-random order of integer ids: one step of the multiplicative generator mod 2^31 - 1."""
    prime = 2_147_483_647
    return F.pmod(F.pmod(column, F.lit(prime)) * F.lit(48_271) + F.lit(seed), F.lit(prime))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
