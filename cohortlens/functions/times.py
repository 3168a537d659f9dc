"""Column expressions over timestamps without a time zone.

``timestampdiff`` reads such timestamps in the session's zone, where an hour is
missing on the night clocks go forward. Subtracting them does not, so elapsed
times are taken from the difference and agree in every session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def _seconds(start: Column, end: Column) -> Column:
    return (end - start).cast("interval second").cast("decimal(18,6)")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Signed fractional minutes from ``start`` to ``end``."""
    return _seconds(start, end).cast("double") / F.lit(60.0)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down (-12 h is -1)."""
    seconds = F.floor(_seconds(start, end)).cast("long")
    return _div(seconds - F.pmod(seconds, F.lit(SECONDS_PER_DAY)), SECONDS_PER_DAY)


def _days_rounded(start: Column, end: Column, days: int = 1) -> Column:
    """Elapsed time in units of ``days`` days, rounded half away from zero to 8 places.

    A day is 864 * 10**8 microseconds, so 8 places are steps of 864 and integer
    division rounds exactly, without the decimal arithmetic of ``round``.
    """
    step = 864 * days
    micros = F.rint(_seconds(start, end).cast("double") * F.lit(1e6)).cast("long")
    half = F.when(micros < 0, F.lit(-step // 2)).otherwise(F.lit(step // 2))
    return _div(micros + half, step) / F.lit(1e8)


def los_days(start: Column, end: Column, scale: int = 8) -> Column:
    """Length of stay in days, rounded half up to ``scale`` places."""
    if scale == 8:
        return _days_rounded(start, end)
    days = _seconds(start, end).cast("double") / F.lit(float(SECONDS_PER_DAY))
    return F.round(days, scale)


def days_between_dates(start: Column, end: Column) -> Column:
    """Difference of the calendar dates, in days."""
    return F.datediff(F.to_date(end), F.to_date(start))


def _calendar_micros(ts: Column) -> Column:
    """A number that orders times as calendars do: every month 100 days, every year 100 months."""
    date = F.year(ts).cast("long") * 10_000 + F.month(ts) * 100 + F.dayofmonth(ts)
    seconds = F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)
    minutes = date * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * F.lit(60_000_000) + seconds.cast("long")


def _completed_years(start: Column, end: Column) -> Column:
    year = 10_000 * SECONDS_PER_DAY * 1_000_000
    return _div(_calendar_micros(end) - _calendar_micros(start), year)


def age_years(t: Column, dob: Column, method: str = "calendar") -> Column:
    """Age at ``t`` under one of four definitions.

    ``calendar``  completed calendar years (integer, towards zero before birth)
    ``days``      whole elapsed days / 365.25
    ``dates``     difference of calendar dates / 365.25
    ``epoch``     elapsed time in 365-day years, rounded to 8 places
    """
    if method == "calendar":
        return _completed_years(dob, t)
    if method == "days":
        return elapsed_days(dob, t) / F.lit(365.25)
    if method == "dates":
        return days_between_dates(dob, t) / F.lit(365.25)
    if method == "epoch":
        return _days_rounded(dob, t, 365)
    raise ValueError(f"unknown age method: {method}")


def half_hour_bucket(ts: Column) -> Column:
    """Hour of day, plus 0.5 in the second half of the hour."""
    return F.hour(ts) + F.when(F.minute(ts) >= 30, 0.5).otherwise(0.0)


def shift_of(ts: Column, null_shift: str | None = None) -> Column:
    """Night (00-07), Day (08-15) or Evening (16-23); ``null_shift`` without a time."""
    hour = F.hour(ts)
    return (
        F.when(hour < 8, "Night")
        .when(hour < 16, "Day")
        .when(hour < 24, "Evening")
        .otherwise(F.lit(null_shift))
    )
