"""The analyses: operators applied to named clinical tables with their usual parameters.

Every function takes a mapping of clinical tables, whatever they were read from.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import fixed_values as fixed
from cohortlens.functions import (
    elapsed_days,
    map_by_contains,
    map_by_regex,
    shift_of,
)
from cohortlens.operators import cohort as cohorts
from cohortlens.operators import distributions as dist
from cohortlens.operators import labs, ordering, sketches, states, status, stays, versions, vitals
from cohortlens.operators.relations import (
    exclude_by,
    keep_by,
    latest_per_key,
    lookup_with_default,
    sample_rows,
)
from cohortlens.operators.survival import kaplan_meier
from cohortlens.operators.counts import join_groups, value_counts
from cohortlens.operators.titles import titles_in_chunks, titles_per_group
from cohortlens.sources.sampling import coherent_sample, orphans
from cohortlens.sources.tables import item_values, preview, save_table

Tables = Mapping[str, DataFrame]
NOTE_KEYS = ("subject_id", "hadm_id", "charttime", "category", "description")
NOTE_COARSE_KEYS = ("subject_id", "hadm_id", "charttime")
# A development sample: the share of patients, and the seed.
SAMPLE = (0.1, 1)
TITLES_PER_CHUNK = 3


def stay_preview(t: Tables) -> DataFrame:
    return preview(t["icustays"].select("subject_id", "hadm_id", "icustay_id"), 100, "icustay_id")


# --- vital signs -----------------------------------------------------------


def vitals_values(t: Tables) -> DataFrame:
    return vitals.vital_values(t["chartevents"], t["patients"], fixed.HEART_RATE_ITEMS)


def vitals_summary(t: Tables) -> DataFrame:
    return vitals.summarise_vitals(vitals_values(t))


def vitals_histogram(t: Tables) -> DataFrame:
    return dist.histogram_fixed(
        vitals_values(t), "heart_rate", 0, fixed.HEART_RATE_BIN_WIDTH, fixed.HEART_RATE_BINS
    )


def vitals_by_age_density(t: Tables) -> DataFrame:
    lo, hi = fixed.HEART_RATE_RANGE
    rate = F.col("heart_rate")
    cells = dist.density_2d(
        vitals_values(t).filter((rate > lo) & (rate <= hi)), "age", "heart_rate", 1, 1
    )
    return cells.withColumnsRenamed({"x_bin": "age_bin", "y_bin": "hr_bin"})


def _measurements(t: Tables) -> DataFrame:
    return vitals.vital_measurements(
        t["chartevents"], t["patients"], fixed.HEART_RATE_ITEMS, *fixed.HEART_RATE_RANGE
    )


def measurements_histogram(t: Tables) -> DataFrame:
    return dist.histogram_fixed(
        _measurements(t), "heart_rate", 0, fixed.HEART_RATE_BIN_WIDTH, fixed.HEART_RATE_BINS
    )


def measurements_by_age_density(t: Tables) -> DataFrame:
    cells = dist.density_2d(_measurements(t), "age", "heart_rate", 1, 1)
    return cells.withColumnsRenamed({"x_bin": "age_bin", "y_bin": "hr_bin"})


def vitals_quantile_sketch(t: Tables) -> DataFrame:
    """Whether quartiles from merged daily sketches stand where they may, by their exact ranks."""
    value, day = F.col("valuenum"), F.to_date("charttime").alias("day")
    rates = t["chartevents"].filter(F.col("itemid").isin(*fixed.HEART_RATE_ITEMS) & value.isNotNull())
    daily = sketches.quantile_sketch(rates.select("itemid", day, "valuenum"), "valuenum", ["itemid", "day"])
    merged = sketches.merge_quantile_sketches(daily, by=["itemid"])
    estimates = sketches.sketch_quantiles(merged, by=["itemid"])
    ranks = sketches.quantile_ranks(rates, "valuenum", estimates, by=["itemid"])
    error = sketches.rank_error()
    stands = (F.col("prob") >= F.col("rank_lo") - error) & (F.col("prob") <= F.col("rank_hi") + error)
    return ranks.select("itemid", "prob", "n_values", stands.alias("within_error"))


def era_histograms(t: Tables) -> DataFrame:
    lo, hi = fixed.ERA_RANGE
    value = F.col("valuenum")
    rates = t["chartevents"].filter(
        F.col("itemid").isin(*fixed.ERA_ITEMS) & (value > lo) & (value < hi)
    )
    return dist.histogram_auto(rates, "valuenum", fixed.ERA_BINS, ["itemid"])


def item_value_counts(t: Tables) -> DataFrame:
    values = item_values(t["chartevents"], fixed.ERA_ITEMS[0], *fixed.ERA_RANGE)
    return value_counts(values, "value")


def proxy_by_shift(t: Tables, null_shift: str | None = None) -> DataFrame:
    """Box-plot statistics per shift. Undated values are left out or join ``null_shift``."""
    charted = t["chartevents"].filter(
        (F.col("itemid") == fixed.PROXY_ITEM) & F.col("valuenum").between(*fixed.PROXY_RANGE)
    )
    shifted = charted.select(shift_of(F.col("charttime"), null_shift).alias("shift"), "valuenum")
    return dist.box_stats(shifted.filter(F.col("shift").isNotNull()), "valuenum", ["shift"])


def proxy_by_shift_undated_evening(t: Tables) -> DataFrame:
    return proxy_by_shift(t, null_shift="Evening")


# --- time stamps of stays --------------------------------------------------


def _stays_in_admissions(t: Tables) -> DataFrame:
    return t["icustays"].join(
        t["admissions"].select("hadm_id", "admittime", "dischtime"), "hadm_id"
    )


def stay_order_flags(t: Tables) -> DataFrame:
    return ordering.order_flags(
        _stays_in_admissions(t), "intime", "outtime", "admittime", "dischtime"
    )


def stay_order_audit(t: Tables) -> DataFrame:
    return ordering.audit_order(
        _stays_in_admissions(t),
        "intime",
        "outtime",
        "admittime",
        "dischtime",
        fixed.ORDER_TOLERANCES,
    )


def _batches(df: DataFrame, key: str, n: int = 3) -> list[DataFrame]:
    """The rows in ``n`` batches, as if they had come one after another."""
    place = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(n))
    return [df.filter(place == i) for i in range(n)]


def stay_order_deltas(t: Tables) -> DataFrame:
    return ordering.order_deltas(t["icustays"], t["admissions"])


def stay_delta_summary(t: Tables) -> DataFrame:
    return ordering.delta_summary(stay_order_deltas(t))


def stay_delta_describe(t: Tables) -> DataFrame:
    return dist.describe_numeric(
        ordering.negative_deltas(stay_order_deltas(t)), "minutes", ["metric"]
    )


def stay_delta_histogram(t: Tables) -> DataFrame:
    return dist.histogram_auto(
        ordering.negative_deltas(stay_order_deltas(t)), "minutes", fixed.DELTA_BINS, ["metric"]
    )


def _delta_counts_from_batches(t: Tables) -> DataFrame:
    broken = ordering.negative_deltas(stay_order_deltas(t))
    counted = [value_counts(batch, "minutes", ["metric"]) for batch in _batches(broken, "minutes")]
    return states.merge_counts(*counted, by=["metric"])


def stay_delta_describe_from_batches(t: Tables) -> DataFrame:
    return dist.describe_counts(_delta_counts_from_batches(t), ["metric"])


def stay_delta_histogram_from_batches(t: Tables) -> DataFrame:
    return dist.histogram_auto_counts(_delta_counts_from_batches(t), fixed.DELTA_BINS, ["metric"])


# --- laboratory results ----------------------------------------------------


def _white_cells(t: Tables) -> DataFrame:
    return t["labevents"].filter(F.col("itemid").isin(*fixed.WHITE_CELL_ITEMS))


def labs_by_half_hour(t: Tables) -> DataFrame:
    return labs.abnormal_by_bucket(
        _white_cells(t), "charttime", "valuenum", *fixed.WHITE_CELL_BAND
    )


def labs_overall(t: Tables) -> DataFrame:
    return labs.abnormal_overall(
        _white_cells(t), "charttime", "valuenum", *fixed.WHITE_CELL_BAND
    )


def labs_by_half_hour_missing_abnormal(t: Tables) -> DataFrame:
    return labs.abnormal_by_bucket(
        _white_cells(t), "charttime", "valuenum", *fixed.WHITE_CELL_BAND, null_policy="abnormal"
    )


# --- notes -----------------------------------------------------------------


def _valid_notes(t: Tables) -> DataFrame:
    error = F.col("iserror")
    return t["noteevents"].filter(
        (error.isNull() | (error != "1")) & F.col("charttime").isNotNull()
    )


def _note_stats(t: Tables) -> DataFrame:
    return versions.version_stats(_valid_notes(t), NOTE_KEYS, "text", "storetime")


def note_versions_from_batches(t: Tables) -> DataFrame:
    kept = [
        states.version_state(batch, NOTE_KEYS, "text", "storetime")
        for batch in _batches(_valid_notes(t), "storetime")
    ]
    return states.version_stats_of(states.merge_version_states(*kept, keys=NOTE_KEYS), NOTE_KEYS)


def note_text_sketches(t: Tables) -> DataFrame:
    """Exact counts of texts and of texts new on the second day, and whether the sketches agree."""
    notes = t["noteevents"].select("category", "text", (F.hour("storetime") < 12).alias("early"))
    exact = notes.groupBy("category").agg(
        F.count_distinct("text").alias("n_texts"),
        F.count_distinct(F.when(F.col("early"), F.col("text"))).alias("n_early"),
    )
    parts = {part: notes.filter("early" if part else "NOT early") for part in (True, False)}
    hll = [sketches.distinct_sketch(part, "text", ["category"]) for part in parts.values()]
    theta = {e: sketches.distinct_sketch(part, "text", ["category"], "theta") for e, part in parts.items()}
    counted = sketches.distinct_estimates(
        sketches.merge_distinct_sketches(*hll, by=["category"]), ["category"]
    ).select("category", F.col("n_distinct").alias("_hll"))
    new = sketches.new_values(theta[False], theta[True], ["category"]).select(
        "category", F.col("n_new").alias("_new")
    )
    error = F.col("n_texts") * sketches.distinct_error()
    met = join_groups(join_groups(exact, counted, ["category"]), new, ["category"])
    return met.select(
        "category",
        "n_texts",
        (F.col("n_texts") - F.col("n_early")).alias("n_new"),
        (F.abs(F.col("_hll") - F.col("n_texts")) <= error).alias("count_within_error"),
        (F.abs(F.col("_new") - F.col("n_texts") + F.col("n_early")) <= error).alias("new_within_error"),
    )


def note_versions(t: Tables) -> DataFrame:
    return _note_stats(t).orderBy(
        F.desc("total_versions"), *[F.col(k).asc_nulls_last() for k in NOTE_KEYS]
    )


def note_version_summary(t: Tables) -> DataFrame:
    return versions.version_summary(_note_stats(t))


def note_version_distribution(t: Tables) -> DataFrame:
    return versions.version_distribution(_note_stats(t))


def note_versions_by_category(t: Tables) -> DataFrame:
    return versions.version_by_category(_note_stats(t))


def note_draft_sizes(t: Tables) -> DataFrame:
    return versions.version_sizes(t["noteevents"], NOTE_COARSE_KEYS)


def note_draft_summary(t: Tables) -> DataFrame:
    return versions.size_summary(note_draft_sizes(t))


# --- cohort, care status, mortality ----------------------------------------


def latest_admissions(t: Tables) -> DataFrame:
    return latest_per_key(t["admissions"], "subject_id", "admittime")


def eol_cohort(t: Tables) -> DataFrame:
    return cohorts.build_cohort(
        t["admissions"],
        t["patients"],
        t["diagnoses_icd"],
        fixed.END_OF_LIFE_CODES,
        fixed.HOSPICE_OR_DEATH,
    )


def _timeline(t: Tables) -> DataFrame:
    return status.status_timeline(
        t["icustays"],
        t["chartevents"],
        fixed.CODE_STATUS_ITEMS,
        fixed.CODE_STATUS_TEXTS,
        fixed.CODE_STATUS_IGNORED_TEXTS,
    )


def _status_columns(timeline: DataFrame) -> DataFrame:
    # Comfort care has a name of its own for its first time, and full code none.
    return timeline.drop("intime", "fullcode_first_charttime").withColumnRenamed(
        "cmo_first_charttime", "timecmo_chart"
    )


def code_status(t: Tables) -> DataFrame:
    return _status_columns(_timeline(t))


def code_status_from_batches(t: Tables) -> DataFrame:
    """Events in batches that overlap in time, each reduced alone."""
    flags = list(fixed.CODE_STATUS_TEXTS)
    kept = [
        status.timeline_state(
            batch, fixed.CODE_STATUS_ITEMS, fixed.CODE_STATUS_TEXTS, fixed.CODE_STATUS_IGNORED_TEXTS
        )
        for batch in _batches(t["chartevents"], "charttime")
    ]
    merged = status.merge_timeline_states(*kept, flags=flags)
    return _status_columns(status.timeline_of(t["icustays"], merged, flags))


def code_status_saved(t: Tables) -> DataFrame:
    return save_table(code_status(t), "code_status")


def admission_status(t: Tables) -> DataFrame:
    return status.status_per_admission(
        status.classify_status(_timeline(t), fixed.CODE_STATUS_PRIORITY)
    )


def cohort_excluding_status(t: Tables) -> DataFrame:
    comfort = admission_status(t).filter(F.col("status") == "cmo")
    return exclude_by(eol_cohort(t), comfort, "hadm_id")


def icu_stay_detail(t: Tables) -> DataFrame:
    return stays.stay_detail(
        t["icustays"], t["admissions"], t["patients"], fixed.ETHNICITY_GROUPS
    )


def development_sample(t: Tables) -> DataFrame:
    """Rows of each table in a sample of the patients, and rows among them without a parent."""
    return orphans(coherent_sample(t, *SAMPLE))


def sampled_stay_detail(t: Tables) -> DataFrame:
    """Stay detail over the sample alone: the same rows as in the whole tables."""
    needed = {name: t[name] for name in ("patients", "admissions", "icustays")}
    return icu_stay_detail(coherent_sample(needed, *SAMPLE))


def _with_race(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "race", map_by_contains(F.col("ethnicity"), fixed.RACE_BY_TEXT, "Other")
    )


def cohort_demographics(t: Tables) -> DataFrame:
    return _with_race(
        cohorts.demographics_of(
            t["icustays"], t["admissions"], t["patients"], cohort_excluding_status(t)
        )
    )


def mortality_labels(t: Tables) -> DataFrame:
    return cohorts.mortality_labels(cohort_excluding_status(t))


def mortality_labels_half_year(t: Tables) -> DataFrame:
    return cohorts.mortality_labels(cohort_excluding_status(t), horizon_days=180)


def mortality_prevalence(t: Tables) -> DataFrame:
    return cohorts.label_prevalence(mortality_labels(t))


def survival_by_group(t: Tables) -> DataFrame:
    """Days from discharge to death by race, for the two groups compared."""
    # One race per admission; were there several, the last in order counts.
    # Only the cohort's stays meet the large joins.
    cohort = cohort_excluding_status(t)
    pairs = keep_by(t["icustays"].select("subject_id", "hadm_id"), cohort, "hadm_id").distinct()
    charted = stays.stays_with_admission(pairs, t["admissions"], t["patients"])
    race = (
        _with_race(charted.select("hadm_id", "ethnicity"))
        .groupBy("hadm_id")
        .agg(F.max("race").alias("race"))
    )
    died = cohort.filter(F.col("dod").isNotNull())
    timed = lookup_with_default(died, race, "hadm_id", "race", "unk").select(
        "race", elapsed_days(F.col("dischtime"), F.col("dod")).alias("days")
    )
    compared = timed.filter(F.col("race").isin("White", "Black"))
    return kaplan_meier(compared, "days", by=["race"], ci=True)


def survival_in_hospital(t: Tables) -> DataFrame:
    """Days from discharge to recorded in-hospital death, by the race named first."""
    died = t["admissions"].filter(F.col("deathtime").isNotNull() & F.col("dischtime").isNotNull())
    timed = died.join(t["patients"].select("subject_id"), "subject_id").select(
        map_by_regex(F.col("ethnicity"), fixed.RACE_PATTERN, "OTHER").alias("race"),
        elapsed_days(F.col("dischtime"), F.col("deathtime")).alias("days"),
        F.lit(1).alias("event"),
    )
    compared = timed.filter(F.col("race").isin("WHITE", "BLACK"))
    return kaplan_meier(compared, "days", event="event", by=["race"])


# --- diagnoses -------------------------------------------------------------


def _diagnosis_titles(t: Tables, sep: str, distinct: bool) -> DataFrame:
    titles = titles_per_group(
        t["diagnoses_icd"], t["d_icd_diagnoses"], "hadm_id", sep, distinct
    )
    return t["admissions"].select("hadm_id", "diagnosis").join(titles, "hadm_id")


def diagnosis_vs_codes(t: Tables) -> DataFrame:
    return _diagnosis_titles(t, "; ", True)


def diagnosis_vs_all_codes(t: Tables) -> DataFrame:
    return _diagnosis_titles(t, ",", False)


def diagnosis_title_chunks(t: Tables) -> DataFrame:
    return titles_in_chunks(
        t["diagnoses_icd"], t["d_icd_diagnoses"], "hadm_id", ",", False, TITLES_PER_CHUNK
    )


def diagnosis_sample(t: Tables) -> DataFrame:
    return sample_rows(diagnosis_vs_codes(t), "hadm_id", 5, seed=1)


ANALYSES: dict[str, Callable[[Tables], DataFrame]] = {
    analysis.__name__: analysis
    for analysis in (
        stay_preview,
        vitals_values,
        vitals_summary,
        vitals_histogram,
        vitals_by_age_density,
        measurements_histogram,
        measurements_by_age_density,
        stay_order_flags,
        stay_order_audit,
        labs_by_half_hour,
        labs_overall,
        labs_by_half_hour_missing_abnormal,
        note_versions,
        note_version_summary,
        note_version_distribution,
        note_versions_by_category,
        note_draft_sizes,
        note_draft_summary,
        latest_admissions,
        eol_cohort,
        code_status,
        code_status_saved,
        admission_status,
        cohort_excluding_status,
        icu_stay_detail,
        cohort_demographics,
        mortality_labels,
        mortality_labels_half_year,
        mortality_prevalence,
        survival_by_group,
        survival_in_hospital,
        diagnosis_vs_codes,
        diagnosis_vs_all_codes,
        diagnosis_sample,
        proxy_by_shift,
        proxy_by_shift_undated_evening,
        stay_order_deltas,
        stay_delta_summary,
        stay_delta_describe,
        stay_delta_histogram,
        era_histograms,
        item_value_counts,
        development_sample,
        sampled_stay_detail,
        vitals_quantile_sketch,
        note_text_sketches,
        note_versions_from_batches,
        stay_delta_describe_from_batches,
        stay_delta_histogram_from_batches,
        code_status_from_batches,
        diagnosis_title_chunks,
    )
}
