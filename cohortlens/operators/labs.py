"""Abnormal-result rates by time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import abnormal_flag, half_hour_bucket


def flag_abnormal(
    df: DataFrame, ts: str, value: str, lo: float, hi: float, null_policy: str = "drop"
) -> DataFrame:
    """``(bucket, abnormal)`` per result.

    ``drop`` leaves out missing and non-positive values; ``abnormal`` keeps
    them, missing ones counting as abnormal.
    """
    if null_policy == "drop":
        df = df.filter(F.col(value) > 0)
    return df.select(
        half_hour_bucket(F.col(ts)).alias("bucket"),
        abnormal_flag(F.col(value), lo, hi, null_policy).alias("abnormal"),
    )


def abnormal_by_bucket(
    df: DataFrame, ts: str, value: str, lo: float, hi: float, null_policy: str = "drop"
) -> DataFrame:
    """Results, abnormal results and abnormal fraction per half hour of the day."""
    flagged = flag_abnormal(df, ts, value, lo, hi, null_policy)
    return (
        flagged.filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(
            F.count("abnormal").alias("n"),
            F.sum("abnormal").alias("n_abnormal"),
            F.avg("abnormal").alias("pct_abnormal"),
        )
        .orderBy("bucket")
    )


def abnormal_overall(
    df: DataFrame, ts: str, value: str, lo: float, hi: float, null_policy: str = "drop"
) -> DataFrame:
    """One row: results in total and the percentage abnormal."""
    return flag_abnormal(df, ts, value, lo, hi, null_policy).agg(
        F.count("abnormal").alias("n"),
        (F.avg("abnormal") * 100).alias("pct_abnormal"),
    )
