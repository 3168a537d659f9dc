"""Column expressions over measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number_lenient(text: Column) -> Column:
    """Decimal text as double, anything else as null.

    Java's parser also reads a type suffix (``80d``), hexadecimal floats and
    the words NaN and Infinity. All of these hold a letter other than the
    exponent's ``e``, so such texts are turned away before the cast.
    """
    return F.when(~text.rlike("[A-DF-Za-df-z]"), text.try_cast("double"))


def abnormal_flag(
    value: Column, lo: float, hi: float, null_policy: str = "drop"
) -> Column:
    """0 inside ``[lo, hi]``, else 1. A null value is null (``drop``) or 1 (``abnormal``)."""
    flag = (~value.between(lo, hi)).cast("int")
    if null_policy == "drop":
        return flag
    if null_policy == "abnormal":
        return F.coalesce(flag, F.lit(1))
    raise ValueError(f"unknown null policy: {null_policy}")


def bin_index(value: Column, lo: Column, width: Column, nbins: int) -> Column:
    """Equal-width bin of a value inside the histogram's range; the last bin is closed.

    The edges ``lo + i * width`` decide: where division rounds a value across an
    edge, the bin is moved back.
    """
    last = F.lit(nbins - 1)
    guess = F.least(F.floor((value - lo) / width), last)
    return (
        guess
        - F.when(value < lo + guess * width, 1).otherwise(0)
        + F.when((guess < last) & (value >= lo + (guess + 1) * width), 1).otherwise(0)
    )
