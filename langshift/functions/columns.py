"""Small column expressions shared by the operators.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def nan_to_null(value: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for presentation; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def snapped(value: Column, eps: float = 1e-12) -> Column:
    """Values that differ from zero only by rounding noise become exactly zero."""
    return F.when(F.abs(value) < eps, F.lit(0.0)).otherwise(value)


def hash60(*parts: Column) -> Column:
    """First 60 bits of the md5 of the parts joined by ':', as a non-negative LONG.

    md5 rather than a Spark-specific hash, so that another SQL engine can redraw the same sample.
    """
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def float_text(value: Column) -> Column:
    """A double in the usual shortest notation: plain from 1e-4 up to 1e16, else d.ddde-05.

    Spark prints 1.0E-4 and 1.0E7 for numbers that the result files show as 0.0001 and 10000000.0.
    """
    text = value.cast("string")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^([^E]+)E", 1), r"\.0$", "")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(mantissa, r"[-.]", "")
    decimals = F.length(digits) - 1
    shifted = F.concat(
        sign,
        F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")),
        F.lit("."),
        F.when(decimals > exponent, F.substring(digits, exponent + 2, F.length(digits))).otherwise(F.lit("0")),
    )
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    return (
        F.when(exponent.isNull() | (value == 0), text)
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .when((exponent >= 7) & (exponent < 16), shifted)
        .otherwise(scientific)
    )
