"""The development sample: its tables fit together, whatever the keys look like."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import ANALYSES
from cohortlens.sources import SCHEMAS, coherent_sample, in_sample, load_tables, orphans
from cohortlens.sources.sampling import PARENTS, ticket_bound
from cohortlens.sources.synthetic import ClinicalViews
from tests.conftest import values

SF = "/root/testdata/sf0.001"


def table(spark, name, rows):
    columns = [f.name for f in SCHEMAS[name]]
    full = [tuple(row.get(c) for c in columns) for row in rows]
    return spark.createDataFrame(full, SCHEMAS[name])


def picked(keys, fraction, seed):
    ticket = lambda k: int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
    return {k for k in keys if ticket(k) < int(fraction * 2**32)}


def test_keys_are_picked_by_the_key_alone(spark):
    df = spark.range(3000)
    got = {r["id"] for r in df.filter(in_sample(F.col("id"), 0.2, 7)).collect()}
    assert got == picked(range(3000), 0.2, 7) and 500 < len(got) < 700
    assert got < {r["id"] for r in df.filter(in_sample(F.col("id"), 0.4, 7)).collect()}
    assert df.filter(in_sample(F.col("id"), 0, 7)).count() == 0
    assert df.filter(in_sample(F.col("id"), 1, 7)).count() == 3000
    with pytest.raises(ValueError):
        ticket_bound(1.5)


def test_views_fit_together(spark):
    whole = dict(ClinicalViews(spark, SF))
    sampled = coherent_sample(whole, 0.3, 5)
    assert {r["n_orphans"] for r in orphans(sampled).collect()} == {0}
    kept = picked([r["subject_id"] for r in whole["patients"].collect()], 0.3, 5)
    assert {r["subject_id"] for r in sampled["patients"].collect()} == kept
    # every row of a kept parent is kept
    for name, links in PARENTS.items():
        for i, (key, parent) in enumerate(links):
            earlier = [k for k, _ in links[:i]]
            hangs = F.col(key).isNotNull()
            for k in earlier:
                hangs = hangs & F.col(k).isNull()
            due = whole[name].filter(hangs).join(sampled[parent].select(key).distinct(), key, "left_semi")
            assert due.count() == sampled[name].filter(hangs).count(), (name, key)


@pytest.mark.parametrize("name", ["code_status", "icu_stay_detail", "stay_order_deltas"])
def test_analyses_of_the_sample_are_those_of_the_whole(spark, name):
    whole = dict(ClinicalViews(spark, SF))
    sampled = coherent_sample(whole, 0.3, 5)
    got, full = ANALYSES[name](sampled), ANALYSES[name](whole)
    due = full.join(sampled["admissions"].select("hadm_id"), "hadm_id", "left_semi").select(*full.columns)
    assert got.count() > 0 and got.exceptAll(due).count() == 0 and due.exceptAll(got).count() == 0


def test_odd_keys(spark):
    patients = table(spark, "patients", [{"subject_id": 1}, {"subject_id": 1}, {"subject_id": None}])
    admissions = table(
        spark,
        "admissions",
        [{"subject_id": 1, "hadm_id": 10}, {"subject_id": 1, "hadm_id": 10}, {"subject_id": 9, "hadm_id": 11},
         {"subject_id": None, "hadm_id": 12}, {"subject_id": 1, "hadm_id": None}],
    )
    labs = table(
        spark,
        "labevents",
        [{"subject_id": 1, "hadm_id": 10, "itemid": 1}, {"subject_id": 1, "hadm_id": None, "itemid": 2},
         {"subject_id": 1, "hadm_id": 11, "itemid": 3}, {"subject_id": None, "hadm_id": None, "itemid": 4},
         {"subject_id": 5, "hadm_id": 10, "itemid": 5}, {"subject_id": 1, "hadm_id": 10, "itemid": 1}],
    )
    got = coherent_sample({"patients": patients, "admissions": admissions, "labevents": labs}, 1.0)
    assert [r["subject_id"] for r in got["patients"].collect()] == [1, 1]
    assert sorted(str(r["hadm_id"]) for r in got["admissions"].collect()) == ["10", "10", "None"]
    # by the admission where there is one, else by the patient
    assert sorted(r["itemid"] for r in got["labevents"].collect()) == [1, 1, 2, 5]
    none = coherent_sample({n: t.limit(0) for n, t in got.items()}, 0.5)
    assert all(t.count() == 0 for t in none.values())
    with pytest.raises(ValueError, match="parents"):
        coherent_sample({"other": patients}, 0.5)


def test_each_fact_is_scanned_once_and_keys_meet_it_in_one_join(spark, setting):
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    events = coherent_sample(dict(ClinicalViews(spark, SF)), 0.1)["chartevents"]
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [event_id") == 1
    assert "BroadcastExchange" not in plan and "NestedLoop" not in plan


def test_loaded_sample_reads_the_tables_above(spark, tmp_path):
    for name, view in ClinicalViews(spark, SF).items():
        view.write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = load_tables(spark, str(tmp_path), tables=["icustays"], sample=0.3, seed=5, sample_by="patient")
    assert set(loaded) == {"icustays"}
    expected = coherent_sample(dict(ClinicalViews(spark, SF)), 0.3, 5)["icustays"]
    assert values(loaded["icustays"], "icustay_id") == values(expected, "icustay_id")
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), sample=0.3, sample_by="row_id")
