"""Sums of doubles that are bit for bit alike for every order and partitioning of the rows.

Adding doubles rounds, so their sum depends on which of them meet first.  Whole numbers do not: each value is cut at
fixed binary places into whole numbers, these are added as longs, and only the totals become doubles again.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BITS = 30  # so that 2 ** 32 rows fit a long
PIECES = 3
LOG_DIGITS = 9
EXPONENTS = 1000  # scores must be smaller than 2 ** 1000 in size


def order_free_sum(value: Column, bound_bits: int = 0) -> Column:
    """Sum of values that are, but for a few, no larger than 2 ** bound_bits in size; NULL counts as no row.

    What a value has beyond 90 binary places below the bound is dropped: values above 2 ** -37 of the bound are added
    exactly, smaller ones to 2 ** -90 of it.  The totals are rounded to doubles at the end, in a fixed order.
    """
    return order_free_total([F.sum(whole) for whole in order_free_parts(value, bound_bits)], bound_bits)


def order_free_parts(value: Column, bound_bits: int = 0) -> list[Column]:
    """The whole numbers of a value that are summed apart."""
    rest, parts = value * F.lit(2.0 ** (PIECE_BITS - bound_bits)), []
    for _ in range(PIECES):
        whole = F.floor(rest)
        parts.append(whole)
        rest = (rest - whole) * F.lit(2.0**PIECE_BITS)
    return parts


def order_free_total(sums: list[Column], bound_bits: int = 0) -> Column:
    """The double that the sums of the parts make."""
    return reduce(add, (total * F.lit(2.0 ** (bound_bits - PIECE_BITS * number)) for number, total in enumerate(sums, 1)))


def unit_scale(bound: Column) -> Column:
    """A power of two that brings values of at most this size close to [-1, 1]; multiplying by it loses nothing.

    1 for a bound of zero or NULL.  Infinite, NaN and huge bounds end the job, as they have no whole numbers.
    """
    exponent = F.greatest(F.ceil(F.round(F.log2(bound), LOG_DIGITS)), F.lit(-EXPONENTS))
    return (
        F.when(F.isnan(bound) | (bound >= 2.0**EXPONENTS), F.raise_error(F.lit("scores must be finite numbers below 2 ** 1000")).cast("double"))
        .when(bound > 0, F.pow(F.lit(2.0), -exponent))
        .otherwise(F.lit(1.0))
    )
