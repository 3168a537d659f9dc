"""Charted vital signs with the patient's age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import age_years, to_number_lenient
from cohortlens.operators.counts import attach, value_counts
from cohortlens.operators.distributions import quantiles


def vital_values(
    events: DataFrame, patients: DataFrame, itemids: Sequence[int], age_method: str = "calendar"
) -> DataFrame:
    """Charted text values of the items as numbers, with age at chart time.

    Only patients on record count. Texts that are no number give a null rate.
    """
    charted = events.filter(F.col("itemid").isin(*itemids) & F.col("value").isNotNull())
    return charted.join(patients.select("subject_id", "dob"), "subject_id").select(
        "subject_id",
        "hadm_id",
        "icustay_id",
        "charttime",
        to_number_lenient(F.col("value")).alias("heart_rate"),
        age_years(F.col("charttime"), F.col("dob"), age_method).alias("age"),
    )


def vital_measurements(
    events: DataFrame,
    patients: DataFrame,
    itemids: Sequence[int],
    lo: float,
    hi: float,
    age_method: str = "days",
) -> DataFrame:
    """Numeric values in ``(lo, hi]``, whether or not the patient is on record."""
    value = F.col("valuenum")
    measured = events.filter(
        F.col("itemid").isin(*itemids) & (value > lo) & (value <= hi)
    )
    return measured.join(patients.select("subject_id", "dob"), "subject_id", "left").select(
        "subject_id",
        "hadm_id",
        "charttime",
        value.alias("heart_rate"),
        age_years(F.col("charttime"), F.col("dob"), age_method).alias("age"),
    )


def summarise_vitals(values: DataFrame) -> DataFrame:
    """One row: values, missing values, means and medians of rate and age, age range.

    Both columns are reduced to one table of value counts, so the joined rows
    are read once and only distinct values travel further.
    """
    counts = value_counts(
        values.select(F.col("heart_rate"), F.col("age").cast("double")).unpivot(
            [], ["heart_rate", "age"], "metric", "value"
        ),
        "value",
        ["metric"],
        keep_missing=True,
    )
    rate, age = F.col("metric") == "heart_rate", F.col("metric") == "age"
    v, n = F.col("value"), F.col("n")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    def mean(cond):
        return F.try_divide(
            F.sum(F.when(cond, v * n)), F.sum(F.when(cond & v.isNotNull(), n))
        )

    basics = counts.agg(
        total(rate).alias("n"),
        total(rate & v.isNull()).alias("n_null"),
        mean(rate).alias("mean_hr"),
        mean(age).alias("mean_age"),
        F.min(F.when(age, v)).alias("min_age"),
        F.max(F.when(age, v)).alias("max_age"),
    )
    medians = (
        quantiles(counts.filter(v.isNotNull()), {"median": 0.5}, ["metric"])
        .agg(
            F.max(F.when(rate, F.col("median"))).alias("median_hr"),
            F.max(F.when(age, F.col("median"))).alias("median_age"),
        )
    )
    return attach(basics, medians, ()).select(
        "n", "n_null", "mean_hr", "median_hr", "mean_age", "median_age", "min_age", "max_age"
    )
