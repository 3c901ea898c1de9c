"""Rounding as Python does it: to the nearest decimal of the number that is stored, not of how it prints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cuts a double into halves whose products are exact.
SPLIT = 2.0**27 + 1.0


def rounded(x: Column, places: int = 5) -> Column:
    """x at so many places, half to even; what has no such places (from 2^53 on), infinities and NaN stay.

    x times the power of ten is a rounded product and its exact error. Where the product lies on a half, the error's sign says
    on which side the number itself lies; elsewhere rounding can't have crossed the half.
    """
    power = 10.0**places
    p = x * power
    cut = lambda v: v * SPLIT - (v * SPLIT - v)
    high, low = cut(x), x - cut(x)
    p_high = power * SPLIT - (power * SPLIT - power)
    p_low = power - p_high
    error = ((high * p_high - p) + high * p_low + low * p_high) + low * p_low
    below = F.floor(p).cast("double")
    part = p - below
    up = (part > 0.5) | (part == 0.5) & ((error > 0) | (error == 0) & (below % 2 != 0))
    return F.when(F.abs(x) < 2.0**53 / power, (below + F.when(up, 1.0).otherwise(0.0)) / power).otherwise(x)
