"""Clinical-shaped views over the synthetic order/event tables used for testing.

Each view fills one schema of :mod:`cohortlens.sources.schemas` from every row
of its source table, with dirty values planted at fixed key remainders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.schemas import schema_of

# Declaring the schemas saves the footer read that schema inference costs per file.
_RAW = {
    name: schema_of(columns)
    for name, columns in {
        "customer": "c_custkey long",
        "orders": (
            "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"
        ),
        "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double",
        "part": "p_partkey long, p_name string, p_size int",
        "events": (
            "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
        ),
        "documents": "doc_id long, text string, lang string, source string",
    }.items()
}


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_RAW[name]).parquet(f"{root}/{name}.parquet")


def patients(spark: SparkSession, root: str) -> DataFrame:
    latest = (
        _read(spark, root, "orders")
        .groupBy("o_custkey")
        .agg({"o_orderdate": "max"})
        .toDF("c_custkey", "latest")
    )
    return (
        _read(spark, root, "customer")
        .join(latest, "c_custkey", "left")
        .selectExpr(
            "c_custkey AS subject_id",
            "if(c_custkey % 2 = 0, 'F', 'M') AS gender",
            "timestampadd(DAY, cast(c_custkey * 37 % 27000 AS int),"
            " if(c_custkey % 40 = 0, timestamp_ntz'1620-01-01', timestamp_ntz'1920-01-01'))"
            " AS dob",
            "if(c_custkey % 3 <> 0,"
            " timestampadd(DAY, cast(c_custkey * 13 % 900 - 5 AS int), latest), null) AS dod",
        )
    )


def admissions(spark: SparkSession, root: str) -> DataFrame:
    return (
        _read(spark, root, "orders")
        .selectExpr(
            "o_custkey AS subject_id",
            "o_orderkey AS hadm_id",
            "timestampadd(HOUR, cast(o_orderkey % 24 AS int), o_orderdate) AS admittime",
            "timestampadd(HOUR, cast(o_orderkey % 24 + o_orderkey * 7 % 360 + 12 AS int),"
            " o_orderdate) AS dischtime",
            "o_orderpriority AS diagnosis",
        )
        .selectExpr(
            "subject_id",
            "hadm_id",
            "admittime",
            "dischtime",
            "if(hadm_id % 20 = 0, timestampadd(HOUR, cast(hadm_id % 7 * 31 - 20 AS int),"
            " dischtime), null) AS deathtime",
            """CASE WHEN diagnosis = '5-LOW' AND hadm_id % 2 = 0 THEN 'HOSPICE-HOME'
                    WHEN diagnosis = '5-LOW' THEN 'DEAD/EXPIRED'
                    WHEN diagnosis = '4-NOT SPECIFIED' AND hadm_id % 4 = 0 THEN null
                    WHEN diagnosis = '2-HIGH' THEN 'SNF'
                    ELSE 'HOME' END AS discharge_location""",
            """element_at(array('WHITE', 'WHITE - RUSSIAN', 'BLACK/AFRICAN AMERICAN',
                    'HISPANIC OR LATINO', 'ASIAN - ASIAN INDIAN', 'SOUTH AMERICAN',
                    'UNABLE TO OBTAIN', 'CARIBBEAN ISLAND'),
                    cast(subject_id % 8 + 1 AS int)) AS ethnicity""",
            "diagnosis",
            "if(hadm_id % 20 = 0, 1, 0) AS hospital_expire_flag",
            "if(hadm_id % 10 = 0, 0, 1) AS has_chartevents_data",
        )
    )


def icustays(spark: SparkSession, root: str) -> DataFrame:
    lines = (
        _read(spark, root, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg({"l_partkey": "min", "l_quantity": "min"})
        .toDF("hadm_id", "line", "p", "q")
    )
    return (
        lines.join(
            admissions(spark, root).select("subject_id", "hadm_id", "admittime"), "hadm_id"
        )
        .selectExpr(
            "subject_id",
            "hadm_id",
            "hadm_id * 10 + line AS icustay_id",
            "timestampadd(HOUR, cast(p % 50 - 2 AS int), admittime) AS intime",
            "p",
            "cast(q AS long) AS q",
        )
        .selectExpr(
            "subject_id",
            "hadm_id",
            "icustay_id",
            "intime",
            "if(p % 101 <> 0, timestampadd(HOUR, cast(q * 4 AS int), intime), null) AS outtime",
        )
    )


def chartevents(spark: SparkSession, root: str) -> DataFrame:
    return (
        _read(spark, root, "events")
        .filter("event_type <> 'purchase'")
        .selectExpr(
            "user_id AS subject_id",
            "event_id % 1000 AS hadm_id",
            "event_id % 1000 * 10 + 1 + event_id % 3 AS icustay_id",
            """CASE WHEN event_type = 'view' THEN 211
                    WHEN event_type = 'click' THEN 220045
                    WHEN event_type = 'error' THEN 5972
                    WHEN event_id % 2 = 0 THEN 128
                    ELSE 223758 END AS itemid""",
            "ts AS charttime",
            """CASE WHEN event_type = 'signup' THEN
                      element_at(array('Full Code', 'Full code', 'Comfort Measures',
                        'Comfort measures only', 'CPR Not Indicate', 'DNI (do not intubate)',
                        'DNR / DNI', 'DNR (do not resuscitate)', 'Other/Remarks', null),
                        cast(event_id % 10 + 1 AS int))
                    WHEN event_id % 97 = 0 THEN 'abc'
                    WHEN event_id % 89 = 0 THEN null
                    WHEN event_id % 83 = 0 THEN '80d'
                    ELSE cast(value AS string) END AS value""",
            "if(event_type <> 'signup' AND event_id % 89 <> 0, value, null) AS valuenum",
            "CASE event_id % 11 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS error",
        )
    )


def labevents(spark: SparkSession, root: str) -> DataFrame:
    return (
        _read(spark, root, "events")
        .filter("event_type = 'purchase'")
        .selectExpr(
            "user_id AS subject_id",
            "event_id % 1000 AS hadm_id",
            "if(event_id % 2 = 0, 51300, 51301) AS itemid",
            "ts AS charttime",
            """CASE WHEN event_id % 53 = 0 THEN null
                    WHEN event_id % 59 = 0 THEN -1.0D
                    ELSE value / 5 END AS valuenum""",
        )
    )


def noteevents(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "documents").selectExpr(
        "cast(length(source) AS long) AS subject_id",
        "if(lang = 'de', null, cast(length(source) AS long)) AS hadm_id",
        "if(doc_id % 71 <> 0, timestamp_ntz'2020-01-01', null) AS charttime",
        "timestampadd(HOUR, cast(doc_id % 48 AS int), timestamp_ntz'2020-01-01') AS storetime",
        "lang AS category",
        "source AS description",
        "if(doc_id % 83 <> 0, text, null) AS text",
        "CASE WHEN doc_id % 61 = 0 THEN '1' WHEN doc_id % 2 = 0 THEN '0' END AS iserror",
    )


def diagnoses_icd(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "lineitem").selectExpr(
        "l_orderkey AS hadm_id",
        "if(l_partkey % 200 = 7, 'V667', cast(l_partkey AS string)) AS icd9_code",
    )


def d_icd_diagnoses(spark: SparkSession, root: str) -> DataFrame:
    return (
        _read(spark, root, "part")
        .selectExpr(
            "cast(p_partkey AS string) AS icd9_code",
            "p_name || ' ' || cast(p_size AS string) AS long_title",
        )
    )


class ClinicalViews(Mapping):
    """The views by name, each built when it is asked for."""

    _views: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        view.__name__: view
        for view in (
            patients,
            admissions,
            icustays,
            chartevents,
            labevents,
            noteevents,
            diagnoses_icd,
            d_icd_diagnoses,
        )
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getitem__(self, name: str) -> DataFrame:
        return self._views[name](self.spark, self.root)

    def __iter__(self) -> Iterator[str]:
        return iter(self._views)

    def __len__(self) -> int:
        return len(self._views)
