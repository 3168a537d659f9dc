"""What every query's plan must and must not hold, with no side small enough to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohortlens import fixed_values as fixed
from cohortlens.operators.vitals import vital_values
from cohortlens.plans import analyses
from cohortlens.sources import load_tables
from cohortlens.sources.synthetic import ClinicalViews

SF = "/root/testdata/sf0.001"


@pytest.fixture
def static(setting):
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.maxMetadataStringLength", "10000")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(analyses.ANALYSES))
def test_plan_is_distributed(spark, static, name):
    plan = plan_of(queries()[name](spark, SF))
    for banned in ("CartesianProduct", "NestedLoopJoin", "Python", "ArrowEval"):
        assert banned not in plan, banned
    assert "BroadcastExchange" not in plan
    # Every window is partitioned: its plan node ends in the list of partition
    # keys, which is not empty, and the list of sort keys, if any.
    for node in re.findall(r"Window \[.*", plan):
        keys = re.search(r"\], \[([^\[\]]*)\](?:, \[[^\[\]]*\])?$", node.strip()).group(1)
        assert keys and "ASC" not in keys and "DESC" not in keys, node


@pytest.mark.parametrize(
    "name", ["vitals_summary", "proxy_by_shift", "era_histograms", "stay_delta_describe", "stay_delta_histogram"]
)
def test_facts_are_scanned_once(spark, static, name):
    plan = plan_of(queries()[name](spark, SF))
    # A repeated use of a scalar subquery prints its plan again, as reused.
    fact = "event_id" if "stay" not in name else "l_orderkey"
    assert len(re.findall(rf"FileScan parquet \[{fact}", plan)) == 1
    assert "ReusedExchange" in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("clinical"))
    for name, view in ClinicalViews(spark, SF).items():
        view.write.parquet(f"{root}/{name}.parquet")
    return load_tables(spark, root)


def scan(plan, column):
    return next(line for line in plan.splitlines() if "FileScan" in line and column in line)


def test_filters_and_columns_reach_the_scan(spark, static, stored):
    plan = plan_of(
        vital_values(stored["chartevents"], stored["patients"], fixed.HEART_RATE_ITEMS).agg(F.avg("age"))
    )
    events = scan(plan, "itemid")
    items = re.search(r"In\(itemid, \[([^\]]*)\]\)", events).group(1)
    assert {int(i) for i in items.split(",")} == set(fixed.HEART_RATE_ITEMS)
    assert "IsNotNull(value)" in events
    read = re.search(r"ReadSchema: struct<([^>]*)>", events).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"subject_id", "itemid", "charttime", "value"}
    assert "*(" in plan  # whole-stage code generation


def test_lab_scan_is_narrow(spark, static, stored):
    plan = plan_of(analyses.labs_by_half_hour(stored))
    labs = scan(plan, "itemid")
    assert "In(itemid, [51300,51301])" in labs and "GreaterThan(valuenum,0.0)" in labs
    assert "subject_id" not in re.search(r"ReadSchema: struct<([^>]*)>", labs).group(1)


def test_notes_are_shuffled_as_digests(spark, static, stored):
    plan = plan_of(analyses.note_version_summary(stored))
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert not re.search(r"\btext#", line)
    assert "sha2(cast(text" in plan


def test_status_events_are_reduced_before_the_join(spark, static, stored):
    plan = plan_of(analyses.code_status(stored))
    join, scan_at = plan.index("SortMergeJoin"), plan.index("itemid")
    assert "partial_min" in plan[join:] and "Window" not in plan and join < scan_at


def test_analyses_agree_on_stored_tables(spark, stored):
    direct = ClinicalViews(spark, SF)
    for name in ("icu_stay_detail", "eol_cohort", "survival_by_group", "note_versions"):
        left, right = (analyses.ANALYSES[name](t) for t in (direct, stored))
        assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0
