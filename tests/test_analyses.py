"""Edge rows through the cohort, status, note, survival and title operators."""

from datetime import datetime as dt
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import fixed_values as fixed
from cohortlens.operators.cohort import (
    build_cohort,
    demographics_of,
    label_prevalence,
    mortality_labels,
)
from cohortlens.operators.labs import abnormal_by_bucket, abnormal_overall
from cohortlens.operators.ordering import audit_order, delta_summary, order_deltas
from cohortlens.operators.status import classify_status, status_per_admission, status_timeline
from cohortlens.operators.stays import stay_detail
from cohortlens.operators.survival import kaplan_meier
from cohortlens.operators.titles import titles_per_group
from cohortlens.operators.versions import (
    size_summary,
    version_by_category,
    version_distribution,
    version_sizes,
    version_stats,
    version_summary,
)
from cohortlens.operators.vitals import summarise_vitals, vital_measurements, vital_values
from cohortlens.sources.schemas import SCHEMAS
from tests.conftest import values

T0 = dt(2150, 1, 1)


def table(spark, name, *rows):
    """Clinical table from dicts; columns left out are null."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([[r.get(c) for c in schema.names] for r in rows], schema)


def days(n):
    return T0 + timedelta(days=n)


# --- cohort ----------------------------------------------------------------


def cohort_tables(spark, admission=None, patient=None, codes=()):
    adm = dict(subject_id=1, hadm_id=10, admittime=T0, dischtime=days(5), discharge_location="HOME")
    pat = dict(subject_id=1, gender="F", dob=dt(2100, 1, 1), dod=days(50))
    return (
        table(spark, "admissions", {**adm, **(admission or {})}),
        table(spark, "patients", {**pat, **(patient or {})}),
        table(spark, "diagnoses_icd", *[dict(hadm_id=h, icd9_code=c) for h, c in codes]),
    )


def cohort(tables, **options):
    return build_cohort(*tables, fixed.END_OF_LIFE_CODES, fixed.HOSPICE_OR_DEATH, **options)


@pytest.mark.parametrize(
    "change, kept",
    [
        ({}, 1),
        (dict(admission=dict(discharge_location=None)), 0),
        (dict(admission=dict(discharge_location="HOSPICE-HOME")), 0),
        (dict(patient=dict(dod=None)), 0),
        (dict(patient=dict(dod=days(7))), 0),
        (dict(patient=dict(dod=days(8))), 1),
        (dict(patient=dict(dob=dt(2132, 1, 2))), 0),
        (dict(patient=dict(dob=dt(1850, 1, 1))), 1),
        (dict(admission=dict(admittime=None)), 0),
        (dict(codes=[(10, "V667")]), 0),
        (dict(codes=[(10, "4019"), (11, "V667")]), 1),
        (dict(codes=[(None, "V667")]), 0),
        (dict(codes=[(None, "4019")]), 1),
    ],
)
def test_cohort_rules(spark, change, kept):
    assert cohort(cohort_tables(spark, **change)).count() == kept


def test_cohort_without_required_death(spark):
    tables = cohort_tables(spark, patient=dict(dod=None))
    assert cohort(tables, require_death=False).count() == 1


def test_cohort_takes_latest_admission_with_ties(spark):
    adm = dict(subject_id=1, dischtime=days(5), discharge_location="HOME")
    admissions = table(
        spark,
        "admissions",
        dict(adm, hadm_id=10, admittime=T0),
        dict(adm, hadm_id=11, admittime=days(1)),
        dict(adm, hadm_id=12, admittime=days(1)),
        # The latest of all still decides if it is itself excluded.
        dict(adm, hadm_id=13, admittime=T0, subject_id=2),
        dict(adm, hadm_id=14, admittime=days(1), subject_id=2, discharge_location="DEAD/EXPIRED"),
    )
    people = [dict(subject_id=s, dob=dt(2100, 1, 1), dod=days(50)) for s in (1, 2)]
    got = cohort((admissions, table(spark, "patients", *people), table(spark, "diagnoses_icd")))
    assert values(got.select("hadm_id"), "hadm_id") == [(11,), (12,)]


def test_mortality_horizon(spark):
    got = spark.createDataFrame(
        [(1, T0, T0 + timedelta(days=365)), (2, T0, T0 + timedelta(days=365, seconds=1)),
         (3, T0, None), (4, T0, T0 + timedelta(days=180))],
        "hadm_id long, dischtime timestamp_ntz, dod timestamp_ntz",
    )
    assert values(mortality_labels(got), "hadm_id") == [(1, 1), (2, 0), (3, 0), (4, 1)]
    assert values(mortality_labels(got, 180), "hadm_id") == [(1, 0), (2, 0), (3, 0), (4, 1)]
    assert values(label_prevalence(mortality_labels(got))) == [(4, 2, 0.5)]


# --- care status -----------------------------------------------------------


def timeline(spark, stays, events):
    return status_timeline(
        table(spark, "icustays", *stays),
        table(spark, "chartevents", *events),
        fixed.CODE_STATUS_ITEMS,
        fixed.CODE_STATUS_TEXTS,
        fixed.CODE_STATUS_IGNORED_TEXTS,
    )


STAY = dict(subject_id=1, hadm_id=10, icustay_id=100, intime=T0)


def charted(value, day=None, **more):
    return dict(icustay_id=100, itemid=128, value=value, charttime=None if day is None else days(day), **more)


def test_first_last_ever_with_undated_event(spark):
    row = timeline(
        spark,
        [STAY],
        [charted("Full code", 1), charted("DNR / DNI", 2), charted("Comfort Measures"),
         charted("CPR Not Indicate", 0, error=1), charted("Other/Remarks", 9), charted(None, 9),
         charted("CPR Not Indicate", 9) | {"itemid": 211}],
    ).first()
    assert row["fullcode_first"] == 1 and row["cmo_first"] == 0
    assert row["cmo_last"] == 1 and row["fullcode_last"] == 0
    assert (row["fullcode"], row["cmo"], row["dnr"], row["dni"], row["dncpr"]) == (1, 1, 1, 1, 0)
    assert row["dnr_first_charttime"] == days(2) and row["cmo_first_charttime"] is None


def test_ties_are_broken_by_text(spark):
    row = timeline(spark, [STAY], [charted("Full code", 1), charted("DNI (do not intubate)", 1)]).first()
    assert row["dni_first"] == 1 and row["fullcode_last"] == 1


def test_stay_without_events_and_error_zero(spark):
    got = timeline(spark, [STAY, dict(STAY, icustay_id=101)], [charted("Full code", 1, error=0)])
    rows = {r["icustay_id"]: r for r in classify_status(got, fixed.CODE_STATUS_PRIORITY).collect()}
    assert rows[100]["status"] == "fullcode" and rows[101]["status"] == "none"
    assert rows[101]["fullcode_last"] is None


def test_latest_stay_decides_the_admission(spark):
    stays = [STAY, dict(STAY, icustay_id=101, intime=days(3)), dict(STAY, hadm_id=11, icustay_id=102)]
    events = [charted("Comfort Measures", 1), charted("Full Code", 4) | {"icustay_id": 101}]
    got = status_per_admission(classify_status(timeline(spark, stays, events), fixed.CODE_STATUS_PRIORITY))
    assert values(got, "hadm_id") == [(10, "fullcode"), (11, "none")]


# --- stays -----------------------------------------------------------------


def test_stay_order(spark):
    stays = table(
        spark, "icustays",
        dict(hadm_id=1, icustay_id=1, intime=days(1), outtime=days(2)),
        dict(hadm_id=1, icustay_id=2, intime=days(-1), outtime=days(3) + timedelta(minutes=10)),
        dict(hadm_id=1, icustay_id=3, intime=days(1), outtime=None),
        dict(hadm_id=1, icustay_id=4, intime=days(1), outtime=days(3) + timedelta(minutes=10.5)),
        dict(hadm_id=9, icustay_id=5, intime=days(1), outtime=days(2)),
    )
    adm = table(spark, "admissions", dict(hadm_id=1, admittime=T0, dischtime=days(3)))
    joined = stays.join(adm.select("hadm_id", "admittime", "dischtime"), "hadm_id")
    row = audit_order(joined, "intime", "outtime", "admittime", "dischtime").first()
    assert (row["total"], row["n_correct"], row["n_inconsistent"]) == (4, 1, 2)
    assert (row["n_in_before"], row["n_out_after"], row["n_within_10"], row["n_within_360"]) == (1, 2, 1, 2)
    assert row["pct_within_10"] == 50.0

    none_late = audit_order(joined.filter("icustay_id = 1"), "intime", "outtime", "admittime", "dischtime")
    assert none_late.first()["pct_within_360"] is None

    deltas = order_deltas(stays, adm)
    rows = {r["icustay_id"]: r for r in deltas.collect()}
    assert rows[4]["delta_out"] == -10.5 and rows[4]["inconsistency_out"]
    assert rows[5]["delta_in"] is None and not rows[5]["inconsistency_in"]
    assert values(delta_summary(deltas)) == [(5, 1, 20.0, 2, 40.0)]


def test_stay_detail_sequences(spark):
    adm = dict(has_chartevents_data=1, dischtime=days(9), ethnicity="WHITE", hospital_expire_flag=0)
    admissions = table(
        spark, "admissions",
        dict(adm, subject_id=1, hadm_id=10, admittime=days(2)),
        dict(adm, subject_id=1, hadm_id=11, admittime=T0),
        dict(adm, subject_id=1, hadm_id=12, admittime=days(-5), has_chartevents_data=0),
        dict(adm, subject_id=1, hadm_id=13, admittime=days(-9)),  # no stay
    )
    stay = dict(subject_id=1, hadm_id=10)
    stays = table(
        spark, "icustays",
        dict(stay, icustay_id=1, intime=days(4), outtime=days(5)),
        dict(stay, icustay_id=2, intime=days(3), outtime=None),
        dict(stay, icustay_id=3, intime=days(3), outtime=days(4)),
        dict(stay, icustay_id=4, intime=None, outtime=None),
        dict(stay, hadm_id=11, icustay_id=5, intime=days(1), outtime=days(2)),
        dict(stay, hadm_id=12, icustay_id=6, intime=days(1), outtime=days(2)),
        dict(stay, subject_id=7, icustay_id=7, intime=days(-50), outtime=days(2)),  # unknown
    )
    patients = table(spark, "patients", dict(subject_id=1, gender="M", dob=dt(2100, 1, 1)))
    got = stay_detail(stays, admissions, patients, fixed.ETHNICITY_GROUPS)
    assert values(
        got.select("icustay_id", "hospstay_seq", "first_hosp_stay", "icustay_seq", "first_icu_stay"),
        "icustay_id",
    ) == [
        (1, 2, False, 2, False),
        (2, 2, False, 1, True),
        (3, 2, False, 1, True),
        (4, 2, False, 3, False),
        (5, 1, True, 1, True),
    ]
    row = got.filter("icustay_id = 1").first()
    assert (row["los_hospital"], row["los_icu"], row["ethnicity_grouped"]) == (7.0, 1.0, "white")


def test_demographics_are_distinct_charted_and_in_the_cohort(spark):
    adm = dict(subject_id=1, has_chartevents_data=1, ethnicity="WHITE")
    admissions = table(
        spark, "admissions", dict(adm, hadm_id=10), dict(adm, hadm_id=11),
        dict(adm, hadm_id=12, has_chartevents_data=0), dict(adm, hadm_id=13),
    )
    stays = table(spark, "icustays", *[dict(subject_id=1, hadm_id=h, icustay_id=i) for i, h in enumerate([10, 10, 11, 12, None])])
    patients = table(spark, "patients", dict(subject_id=1, gender="M"))
    members = spark.createDataFrame([(10,), (12,), (13,)], "hadm_id long")
    assert values(demographics_of(stays, admissions, patients, members)) == [(1, 10, "M", "WHITE")]


# --- notes -----------------------------------------------------------------

NOTE_KEYS = ["subject_id", "hadm_id", "charttime", "category", "description"]


@pytest.mark.parametrize("compare", ["digest", "text"])
def test_versions_count_missing_texts_as_duplicates(spark, compare):
    note = dict(subject_id=1, hadm_id=None, charttime=T0, category="c", description="d")
    df = table(spark, "noteevents", *[dict(note, text=t, storetime=days(i)) for i, t in enumerate(["a", "a", None, None])])
    row = version_stats(df, NOTE_KEYS, "text", "storetime", compare=compare).first()
    assert (row["total_versions"], row["unique_text_versions"]) == (4, 1)
    assert (row["exact_duplicates"], row["potential_drafts"]) == (3, 3)
    assert (row["first_storetime"], row["latest_storetime"]) == (T0, days(3))
    assert version_stats(df, NOTE_KEYS, "text", "storetime", drop_null_keys=True).count() == 0


def test_null_keys_grouped_or_dropped(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "k long")
    assert values(version_sizes(df, ["k"], drop_null_keys=False), "k") == [(None, 2), (1, 1)]
    assert values(version_sizes(df, ["k"])) == [(1, 1)]
    assert values(size_summary(version_sizes(df, ["k"], False))) == [(2, 1, 2)]


def test_version_reports(spark):
    stats = spark.createDataFrame(
        [("a", 1, 0), ("a", 2, 0), ("b", 2, 1), (None, 3, 2)],
        "category string, total_versions long, exact_duplicates long",
    ).withColumn("potential_drafts", F.col("total_versions") - 1)
    assert values(version_summary(stats)) == [(4, 3, 3, 2.0, 2, 3)]
    assert values(version_distribution(stats)) == [(1, 1), (2, 2), (3, 1)]
    assert values(version_by_category(stats)) == [("b", 1, 2.0, 2), ("a", 2, 1.5, 2)]


def test_average_is_rounded_half_to_even(spark):
    stats = spark.createDataFrame([(1, 0, 0)] * 7 + [(2, 0, 0)], "total_versions long, exact_duplicates long, potential_drafts long")
    assert version_summary(stats).first()["avg_versions"] == round(9 / 8, 2) == 1.12


# --- labs and vitals -------------------------------------------------------


def test_lab_policies_differ(spark):
    df = table(
        spark, "labevents",
        *[dict(charttime=dt(2150, 1, 1, 4, 30), valuenum=v) for v in (None, -1.0, 5.0, 20.0)],
        dict(charttime=None, valuenum=5.0),
    )
    drop = abnormal_by_bucket(df, "charttime", "valuenum", 4.5, 11.0)
    keep = abnormal_by_bucket(df, "charttime", "valuenum", 4.5, 11.0, "abnormal")
    assert values(drop) == [(4.5, 2, 1, 0.5)]
    assert values(keep) == [(4.5, 4, 3, 0.75)]
    assert values(abnormal_overall(df, "charttime", "valuenum", 4.5, 11.0)) == [(3, pytest.approx(100 / 3))]


def test_vitals_join_and_summary(spark):
    events = table(
        spark, "chartevents",
        *[dict(subject_id=s, itemid=i, charttime=T0, value=v, valuenum=x) for s, i, v, x in [
            (1, 211, "80", 80.0), (1, 211, "90", 90.0), (1, 5972, "80d", 80.0),
            (2, 220045, "70", 70.0), (9, 211, "60", 60.0), (1, 1, "50", 50.0), (1, 211, None, 0.0)]],
    )
    patients = table(spark, "patients", dict(subject_id=1, dob=dt(2100, 1, 1)), dict(subject_id=2, dob=None))
    row = summarise_vitals(vital_values(events, patients, fixed.HEART_RATE_ITEMS)).first()
    assert tuple(row) == (4, 1, 80.0, 80.0, 50.0, 50.0, 50.0, 50.0)
    measured = vital_measurements(events, patients, fixed.HEART_RATE_ITEMS, 0, 250)
    assert sorted(r["heart_rate"] for r in measured.collect()) == [60.0, 70.0, 80.0, 80.0, 90.0]


def test_summary_of_no_vitals(spark):
    empty = vital_values(table(spark, "chartevents"), table(spark, "patients"), [211])
    assert tuple(summarise_vitals(empty).first()) == (0, 0, None, None, None, None, None, None)


# --- survival --------------------------------------------------------------


def test_curve_with_censoring(spark):
    df = spark.createDataFrame([(0, 1), (2, 1), (2, 1), (5, 0), (9, 1), (None, 1)], "t long, e int")
    got = values(kaplan_meier(df, "t", "e"), "t")
    assert [r[:3] for r in got] == [(0, 5, 1), (2, 4, 2), (5, 2, 0), (9, 1, 1)]
    assert [r[3] for r in got] == pytest.approx([0.8, 0.4, 0.4, 0.0])


def test_curve_without_censoring_is_the_empirical_distribution(spark):
    ts = np.random.default_rng(5).integers(0, 40, 300)
    df = spark.createDataFrame([("x", int(t)) for t in ts] + [("y", 1), ("y", 1)], "g string, t long")
    for g, t, _, _, survival in values(kaplan_meier(df, "t", by=["g"])):
        expected = 0.0 if g == "y" else (ts > t).mean()
        assert survival == pytest.approx(expected, abs=1e-12)


def test_confidence_limits(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "t long, e int")
    got = {r["t"]: r for r in kaplan_meier(df, "t", "e", ci=True).collect()}
    theta = 1.959963984540054 * np.sqrt(1 / (4 * 3) + 1 / (3 * 2)) / abs(np.log(0.5))
    assert got[2]["lower"] == pytest.approx(0.5 ** np.exp(theta))
    assert got[2]["upper"] == pytest.approx(0.5 ** np.exp(-theta))
    assert got[4]["survival"] == 0.0 and got[4]["lower"] is None
    wider = kaplan_meier(df, "t", "e", ci=True, alpha=0.01).filter("t = 2").first()
    assert wider["lower"] < got[2]["lower"]


# --- titles ----------------------------------------------------------------


@pytest.mark.parametrize(
    "distinct, sep, expected", [(True, "; ", "a; b"), (False, ",", "a,b,b")]
)
def test_titles(spark, distinct, sep, expected):
    codes = table(spark, "diagnoses_icd", *[dict(hadm_id=h, icd9_code=c) for h, c in [
        (1, "B"), (1, "A"), (1, "B"), (1, "N"), (2, "N"), (3, "?")]])
    titles = table(spark, "d_icd_diagnoses", *[dict(icd9_code=c, long_title=t) for c, t in [
        ("A", "a"), ("B", "b"), ("N", None)]])
    got = titles_per_group(codes, titles, "hadm_id", sep, distinct)
    assert values(got, "hadm_id") == [(1, expected), (2, None)]
