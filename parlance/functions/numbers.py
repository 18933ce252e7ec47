"""Rounding as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0


def round_half_even(col: Column, digits: int) -> Column:
    """Round the exact binary value half to even, for up to 6 digits.

    Spark's bround works on the shortest decimal form of a double, which turns values that merely
    print as a tie into ties. The product with the power of ten is therefore taken exactly, as its
    rounded value plus the rounding error.
    """
    x = col.cast("double")
    ten = F.lit(float(10**digits))
    product = x * ten
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * ten - product) + (x - high) * ten
    base = F.floor(product).cast("double")
    part = product - base
    tie = part == 0.5
    up = (part > 0.5) | (tie & ((error > 0) | ((error == 0) & (base % 2 != 0))))
    return F.when(up, base + 1).otherwise(base) / ten
