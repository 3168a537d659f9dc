"""Cohort selection, demographics and mortality labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import age_years, days_between_dates
from cohortlens.operators.relations import keep_by, not_in
from cohortlens.operators.stays import stays_with_admission


def build_cohort(
    admissions: DataFrame,
    patients: DataFrame,
    diagnoses: DataFrame,
    exclude_codes: Sequence[str],
    exclude_dispositions: Sequence[str],
    min_age: float = 18,
    min_days_to_death: int = 3,
    require_death: bool = True,
) -> DataFrame:
    """Latest admission of each adult patient, minus stated codes and dispositions.

    Patients must live ``min_days_to_death`` days past discharge, and with
    ``require_death`` must have a recorded death. Admissions tied for latest all
    count. Rows without a disposition are left out, and so is everyone if an
    excluded code is recorded without an admission (SQL ``NOT IN``).

    Patients are reduced first: the latest admission time and the birth date
    settle the age test before the wide admission rows are joined.
    """
    people = patients.select("subject_id", "gender", "dob", "dod")
    if require_death:
        people = people.filter(F.col("dod").isNotNull())
    latest = admissions.groupBy("subject_id").agg(F.max("admittime").alias("admittime"))
    adults = latest.join(people, "subject_id").filter(
        age_years(F.col("admittime"), F.col("dob"), "dates") >= min_age
    )
    discharged = admissions.filter(~F.col("discharge_location").isin(*exclude_dispositions))
    survived = discharged.join(adults, ["subject_id", "admittime"]).filter(
        F.col("dod").isNull()
        | (days_between_dates(F.col("dischtime"), F.col("dod")) >= min_days_to_death)
    )
    coded = diagnoses.filter(F.col("icd9_code").isin(*exclude_codes)).select("hadm_id")
    return not_in(survived, coded, "hadm_id").select(
        *admissions.columns, "gender", "dob", "dod"
    )


def demographics_of(
    stays: DataFrame, admissions: DataFrame, patients: DataFrame, cohort: DataFrame
) -> DataFrame:
    """Distinct (patient, admission, gender, ethnicity) of the cohort's charted stays.

    Stays shrink to their keys first, so an admission or patient with very many
    stays is combined before the joins.
    """
    pairs = stays.select("subject_id", "hadm_id").distinct()
    detail = stays_with_admission(pairs, admissions, patients)
    return (
        keep_by(detail, cohort, "hadm_id")
        .select("subject_id", "hadm_id", "gender", "ethnicity")
        .distinct()
    )


def mortality_labels(cohort: DataFrame, horizon_days: int = 365) -> DataFrame:
    """``(hadm_id, label)``: 1 if death came within the horizon after discharge."""
    deadline = F.timestamp_add("DAY", F.lit(horizon_days), F.col("dischtime"))
    died = F.coalesce(F.col("dod") <= deadline, F.lit(False))
    return cohort.groupBy("hadm_id").agg(F.max(died.cast("int")).alias("label"))


def label_prevalence(labels: DataFrame) -> DataFrame:
    """One row: labelled admissions, positives and their share."""
    return labels.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("n_positive"),
        F.avg("label").alias("prevalence"),
    )
