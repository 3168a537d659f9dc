"""Schemas of the clinical tables, columns in use only.

Timestamps carry no zone: the source systems record local wall-clock time.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampNTZType,
)

_TYPES: dict[str, DataType] = {
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "timestamp_ntz": TimestampNTZType(),
}


def schema_of(columns: str) -> StructType:
    """Schema from ``"name type, name type"``; unlike a DDL parse, it needs no session."""
    schema = StructType()
    for column in columns.split(","):
        name, kind = column.split()
        schema.add(name, _TYPES[kind])
    return schema


_COLUMNS = {
    "patients": "subject_id long, gender string, dob timestamp_ntz, dod timestamp_ntz",
    "admissions": (
        "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz,"
        " deathtime timestamp_ntz, discharge_location string, ethnicity string,"
        " diagnosis string, hospital_expire_flag int, has_chartevents_data int"
    ),
    "icustays": (
        "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz,"
        " outtime timestamp_ntz"
    ),
    "chartevents": (
        "subject_id long, hadm_id long, icustay_id long, itemid int,"
        " charttime timestamp_ntz, value string, valuenum double, error int"
    ),
    "labevents": (
        "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, valuenum double"
    ),
    "noteevents": (
        "subject_id long, hadm_id long, charttime timestamp_ntz, storetime timestamp_ntz,"
        " category string, description string, text string, iserror string"
    ),
    "diagnoses_icd": "hadm_id long, icd9_code string",
    "d_icd_diagnoses": "icd9_code string, long_title string",
}

SCHEMAS: dict[str, StructType] = {
    name: schema_of(columns) for name, columns in _COLUMNS.items()
}
