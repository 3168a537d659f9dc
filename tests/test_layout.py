"""What tables laid out for their reading spare: shuffles and row groups."""

import glob
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortlens import fixed_values as fixed
from cohortlens.operators.vitals import vital_values
from cohortlens.sources import convert_tables, save_bucketed, save_clustered
from cohortlens.sources.synthetic import ClinicalViews
from tests.conftest import values

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def bucketed(spark, setting, tmp_path):
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    views, names, tables = ClinicalViews(spark, SF), [], {}
    for name in ("icustays", "admissions", "diagnoses_icd"):
        names.append(f"{name}_{uuid.uuid4().hex}")
        tables[name] = save_bucketed(views[name], names[-1], 4, ["hadm_id"], path=str(tmp_path / name))
    yield tables
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_bucketed_tables_join_without_a_shuffle(spark, bucketed):
    views = ClinicalViews(spark, SF)
    joined = lambda t: (
        t["icustays"].join(t["admissions"].drop("subject_id"), "hadm_id").join(t["diagnoses_icd"], "hadm_id", "left_semi")
    )
    own = joined(bucketed)
    assert "Exchange" not in plan_of(own) and "Exchange" in plan_of(joined(views))
    by_key = own.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan_of(by_key)
    other = joined(views)
    assert own.exceptAll(other.select(*own.columns)).count() == 0 and own.count() == other.count() > 0


def test_bucketed_tables_are_replaced(spark, bucketed, tmp_path):
    name = f"again_{uuid.uuid4().hex}"
    try:
        save_bucketed(spark.range(9).toDF("a"), name, 2, ["a"], path=str(tmp_path / "again"))
        got = save_bucketed(spark.range(3).toDF("a"), name, 2, ["a"], path=str(tmp_path / "again"))
        assert values(got, "a") == [(0,), (1,), (2,)]
        assert len(glob.glob(str(tmp_path / "again" / "part-*"))) <= 2  # a file for each bucket
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def scanned(df):
    """Rows that a query's scan hands on, after row groups were skipped."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    leaves = node.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def groups_to_read(folder, itemids):
    """Row groups whose range of item ids may hold one of those wanted, of all."""
    kept = total = 0
    for file in glob.glob(f"{folder}/part-*"):
        meta = pq.ParquetFile(file).metadata
        column = [meta.schema.column(i).name for i in range(meta.num_columns)].index("itemid")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            total += 1
            kept += any(stats.min <= i <= stats.max for i in itemids)
    return kept, total


def test_clustered_events_are_skipped(spark, setting, tmp_path):
    setting("spark.sql.adaptive.enabled", "false")
    # many items, so that those of one analysis are a small part
    events = ClinicalViews(spark, SF)["chartevents"].crossJoin(spark.range(40).select(F.col("id").cast("int").alias("i")))
    events = events.withColumn("itemid", F.col("itemid") + F.col("i") * 7).drop("i")
    plain, sorted_ = str(tmp_path / "plain"), str(tmp_path / "sorted")
    events.repartition(4).write.option("parquet.block.size", str(64 * 1024)).parquet(plain)
    clustered = save_clustered(events, sorted_, ["itemid", "charttime"], ["itemid"], 4, 64 * 1024)
    wanted = fixed.HEART_RATE_ITEMS
    some, every = groups_to_read(sorted_, wanted)
    all_plain, total_plain = groups_to_read(plain, wanted)
    assert all_plain == total_plain and some < every / 2
    people = ClinicalViews(spark, SF)["patients"]
    unsorted = spark.read.schema(events.schema).parquet(plain)
    pick = lambda df: df.filter(F.col("itemid").isin(*wanted) & F.col("value").isNotNull())
    assert scanned(pick(clustered)) < 0.5 * scanned(pick(unsorted))
    a, b = (vital_values(t, people, wanted) for t in (clustered, unsorted))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_bloom_filters_spare_what_ranges_cannot(spark, tmp_path):
    # even numbers alone: an odd one lies in every range but in no Bloom filter
    df = spark.range(0, 40_000, 2, 1).select(F.col("id").cast("int").alias("itemid"), F.xxhash64("id").alias("x"))
    with_bloom = save_clustered(df, str(tmp_path / "b"), ["x"], ["itemid"], 1)
    without = save_clustered(df, str(tmp_path / "n"), ["x"], [], 1)
    assert scanned(with_bloom.filter("itemid = 20001")) == 0 < scanned(without.filter("itemid = 20001"))
    assert with_bloom.filter("itemid = 20002").count() == 1


def test_csv_is_converted_once(spark, tmp_path):
    (tmp_path / "noteevents.csv").write_text(
        "subject_id,hadm_id,charttime,storetime,category,description,text,iserror\n"
        '1,2,2150-01-01,2150-01-01 10:00:00,c,d,"line ""one""\nline two",\n'
    )
    (tmp_path / "labevents.csv").write_text(
        "subject_id,hadm_id,itemid,charttime,valuenum\n1,7,51301,2150-01-02,5\n1,7,51300,2150-01-01,4.5\n"
    )
    target = str(tmp_path / "parquet")
    got = convert_tables(
        spark, str(tmp_path), target, tables=["noteevents", "labevents"], clusters={"labevents": ["itemid"]}
    )
    assert got["noteevents"].first()["text"] == 'line "one"\nline two'
    assert [r["itemid"] for r in got["labevents"].orderBy("itemid").collect()] == [51300, 51301]
    assert all(glob.glob(f"{target}/{n}.parquet/part-*") for n in got)
