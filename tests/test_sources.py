from datetime import datetime as dt

import pytest

from cohortlens.sources import SCHEMAS, item_values, load_tables, preview, save_table
from cohortlens.sources.synthetic import ClinicalViews
from cohortlens.sources.tables import jdbc_options, unreadable_cells
from tests.conftest import values

SF = "/root/testdata/sf0.001"


def test_views_fill_the_schemas(spark):
    views = ClinicalViews(spark, SF)
    assert set(views) == set(SCHEMAS) and len(views) == len(SCHEMAS)
    for name, view in views.items():
        assert [(f.name, f.dataType) for f in view.schema] == [
            (f.name, f.dataType) for f in SCHEMAS[name]
        ], name


def test_parquet_subset_and_sample(spark, tmp_path):
    views = ClinicalViews(spark, SF)
    for name in ("labevents", "patients"):
        views[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = load_tables(spark, str(tmp_path), tables=["labevents", "patients"])
    assert set(loaded) == {"labevents", "patients"}
    assert loaded["labevents"].exceptAll(views["labevents"]).count() == 0
    half = load_tables(spark, str(tmp_path), tables=["labevents"], sample=0.5, seed=3)["labevents"]
    again = load_tables(spark, str(tmp_path), tables=["labevents"], sample=0.5, seed=3)["labevents"]
    assert 0 < half.count() < loaded["labevents"].count()
    assert values(half, *half.columns) == values(again, *again.columns)


def test_csv_by_header_with_extra_columns_and_bad_cells(spark, tmp_path):
    (tmp_path / "LABEVENTS.csv").write_text(
        '"ROW_ID","SUBJECT_ID","HADM_ID","ITEMID","CHARTTIME","VALUE","VALUENUM"\n'
        '1,5,7,51300,2150-01-01 04:30:00,"4,5",4.5\n'
        "2,5,,51301,,x,x\n"
    )
    df = load_tables(
        spark, str(tmp_path), "csv", ["labevents"], {"upper": "true"}
    )["labevents"]
    assert values(df) == [
        (5, 7, 51300, dt(2150, 1, 1, 4, 30), 4.5),
        (5, None, 51301, None, None),
    ]


def test_csv_notes_over_several_lines(spark, tmp_path):
    (tmp_path / "noteevents.csv").write_text(
        "subject_id,hadm_id,charttime,storetime,category,description,text,iserror\n"
        '1,2,2150-01-01,2150-01-01 10:00:00,c,d,"line ""one""\nline two",\n'
    )
    df = load_tables(spark, str(tmp_path), "csv", ["noteevents"])["noteevents"]
    row = df.first()
    assert row["text"] == 'line "one"\nline two' and row["iserror"] is None
    assert row["charttime"] == dt(2150, 1, 1)


@pytest.mark.parametrize("temp", [True, False])
def test_saved_table_is_replaced(spark, tmp_path, temp):
    name = f"derived_{temp}".lower()
    try:
        assert values(save_table(spark.range(3).toDF("a"), name, temp=temp), "a") == [(0,), (1,), (2,)]
        assert values(save_table(spark.range(1).toDF("b"), name, temp=temp)) == [(0,)]
        assert spark.table(name).columns == ["b"]
    finally:
        if temp:
            spark.catalog.dropTempView(name)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_bound_item_query(spark):
    df = spark.createDataFrame(
        [(211, 1.0), (211, 0.0), (211, 300.0), (211, None), (9, 5.0)], "itemid int, valuenum double"
    )
    assert values(item_values(df, 211, 0, 300)) == [(1.0,)]


def test_preview_is_ordered(spark):
    assert values(preview(spark.range(10), 2, "id")) == [(0,), (1,)]


def test_no_tables_asked_for_loads_none(spark, tmp_path):
    assert load_tables(spark, str(tmp_path), "csv", []) == {}


def test_bad_cells_are_counted_or_stop_the_job(spark, tmp_path):
    (tmp_path / "labevents.csv").write_text(
        "subject_id,hadm_id,itemid,charttime,valuenum\n1,x,51300,not a time,4.5\n2,,51301,2150-01-01,\n"
    )
    load = lambda **how: load_tables(spark, str(tmp_path), "csv", ["labevents"], **how)["labevents"]
    assert values(load(), "subject_id")[0] == (1, None, 51300, None, 4.5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load(bad_values="fail").collect()
    with pytest.raises(ValueError):
        load(bad_values="keep")
    texts = spark.read.csv(str(tmp_path / "labevents.csv"), header=True)
    counts = {r["column"]: r["n"] for r in unreadable_cells(texts, "labevents").collect()}
    assert counts == {"subject_id": 0, "hadm_id": 1, "itemid": 0, "charttime": 1, "valuenum": 0}


def test_jdbc_options_name_the_schema_and_keep_zoneless_times():
    options = jdbc_options("jdbc:x", "labevents", "clinical", {"numPartitions": "9"})
    assert options == {"url": "jdbc:x", "dbtable": "clinical.labevents", "preferTimestampNTZ": "true", "numPartitions": "9"}
    assert jdbc_options("jdbc:x", "labevents")["dbtable"] == "labevents"
