"""Audits of inner intervals (unit stays) against outer ones (admissions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import elapsed_minutes


def _percent(part, whole):
    return F.try_divide(part * 100.0, whole)


def order_flags(
    df: DataFrame, start: str, end: str, outer_start: str, outer_end: str
) -> DataFrame:
    """Rows with 0/1 flags and signed minutes by which the inner interval sticks out."""
    return df.withColumns(
        {
            "starts_before": F.when(F.col(start) < F.col(outer_start), 1).otherwise(0),
            "ends_after": F.when(F.col(end) > F.col(outer_end), 1).otherwise(0),
            "minutes_before": elapsed_minutes(F.col(start), F.col(outer_start)),
            "minutes_after": elapsed_minutes(F.col(outer_end), F.col(end)),
        }
    )


def audit_order(
    df: DataFrame,
    start: str,
    end: str,
    outer_start: str,
    outer_end: str,
    tolerances: Sequence[int] = (10, 360),
) -> DataFrame:
    """One row of counts, in one pass: intervals in order, out of order, and late by little.

    A comparison with a missing time holds neither way, so such intervals are
    neither correct nor inconsistent.
    """
    before = F.col(start) < F.col(outer_start)
    after = F.col(end) > F.col(outer_end)
    correct = (F.col(start) >= F.col(outer_start)) & (F.col(end) <= F.col(outer_end))
    late = elapsed_minutes(F.col(outer_end), F.col(end))
    within = [after & late.between(0, k) for k in tolerances]
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(correct).alias("n_correct"),
        F.count_if(before | after).alias("n_inconsistent"),
        F.count_if(before).alias("n_in_before"),
        F.count_if(after).alias("n_out_after"),
        *[F.count_if(w).alias(f"n_within_{k}") for w, k in zip(within, tolerances)],
    )
    return counted.select(
        "total",
        "n_correct",
        _percent(F.col("n_correct"), F.col("total")).alias("pct_correct"),
        "n_inconsistent",
        "n_in_before",
        _percent(F.col("n_in_before"), F.col("total")).alias("pct_in_before"),
        "n_out_after",
        _percent(F.col("n_out_after"), F.col("total")).alias("pct_out_after"),
        *[f"n_within_{k}" for k in tolerances],
        *[
            _percent(F.col(f"n_within_{k}"), F.col("n_out_after")).alias(f"pct_within_{k}")
            for k in tolerances
        ],
    )


def order_deltas(
    inner: DataFrame,
    outer: DataFrame,
    on: str = "hadm_id",
    start: str = "intime",
    end: str = "outtime",
    outer_start: str = "admittime",
    outer_end: str = "dischtime",
) -> DataFrame:
    """Each inner interval with minutes after the outer start and before the outer end.

    Intervals without an outer one stay, with missing minutes and no
    inconsistency.
    """
    joined = inner.join(outer.select(on, outer_start, outer_end), on, "left")
    deltas = joined.withColumns(
        {
            "delta_in": elapsed_minutes(F.col(outer_start), F.col(start)),
            "delta_out": elapsed_minutes(F.col(end), F.col(outer_end)),
        }
    )
    return deltas.withColumns(
        {
            "inconsistency_in": F.coalesce(F.col("delta_in") < 0, F.lit(False)),
            "inconsistency_out": F.coalesce(F.col("delta_out") < 0, F.lit(False)),
        }
    )


def delta_summary(deltas: DataFrame) -> DataFrame:
    """One row: stays in total, and how many (and what percentage) break each end."""
    counted = deltas.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("inconsistency_in").alias("n_in"),
        F.count_if("inconsistency_out").alias("n_out"),
    )
    return counted.select(
        "total",
        "n_in",
        _percent(F.col("n_in"), F.col("total")).alias("pct_in"),
        "n_out",
        _percent(F.col("n_out"), F.col("total")).alias("pct_out"),
    )


def negative_deltas(deltas: DataFrame) -> DataFrame:
    """``(metric, minutes)`` rows of the inconsistent ends only."""
    return deltas.unpivot([], ["delta_in", "delta_out"], "metric", "minutes").filter(
        F.col("minutes") < 0
    )
