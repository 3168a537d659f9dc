"""Demographic and administrative detail of every unit stay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import age_years, los_days, map_by_list
from cohortlens.operators.counts import with_dense_rank


def _charted(admissions: DataFrame) -> DataFrame:
    return admissions.filter("has_chartevents_data = 1").select(
        "hadm_id",
        F.col("subject_id").alias("adm_subject_id"),
        "admittime",
        "dischtime",
        "ethnicity",
        "hospital_expire_flag",
    )


def stays_with_admission(
    stays: DataFrame, admissions: DataFrame, patients: DataFrame
) -> DataFrame:
    """Stays of charted admissions, with admission and patient columns.

    ``adm_subject_id`` is the admission's own patient, which dirty data may
    give differently from the stay's.
    """
    people = patients.select("subject_id", "gender", "dob", "dod")
    return stays.join(_charted(admissions), "hadm_id").join(people, "subject_id")


def stay_detail(
    stays: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    ethnicity_map: Mapping[str, Sequence[str]],
) -> DataFrame:
    """One row per stay: demographics, lengths of stay, sequence numbers, first-stay flags.

    Stays are numbered within their admission, and admissions within their patient
    by the distinct times of those that reach the result: charted ones with a stay of
    a known patient. Both numbers are worked out on the joined rows, so that stays,
    admissions and patients are each read once.
    """
    joined = stays_with_admission(stays, admissions, patients)
    numbered = with_dense_rank(joined, ["hadm_id"], "intime", "icustay_seq")
    ranked = with_dense_rank(numbered, ["adm_subject_id"], "admittime", "hospstay_seq")
    return ranked.select(
        "subject_id",
        "hadm_id",
        "icustay_id",
        "gender",
        "dod",
        "admittime",
        "dischtime",
        los_days(F.col("admittime"), F.col("dischtime")).alias("los_hospital"),
        age_years(F.col("intime"), F.col("dob"), "epoch").alias("admission_age"),
        "ethnicity",
        map_by_list(F.col("ethnicity"), ethnicity_map, "other").alias("ethnicity_grouped"),
        "hospital_expire_flag",
        "hospstay_seq",
        (F.col("hospstay_seq") == 1).alias("first_hosp_stay"),
        "intime",
        "outtime",
        los_days(F.col("intime"), F.col("outtime")).alias("los_icu"),
        "icustay_seq",
        (F.col("icustay_seq") == 1).alias("first_icu_stay"),
    )
