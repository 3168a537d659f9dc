"""Partial results that are kept and merged, so that a new batch never re-reads history.

A state is a table whose rows from different batches merge by group with sums,
minima and maxima: value counts (:func:`value_counts`, for summaries and histograms),
note versions, and care-status timelines. Merging is associative and commutative, so
any split and order of batches gives what one pass over all rows gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.sketches import union_of


def save_batch(state: DataFrame, path: str, batch: str) -> None:
    """Keep the state of one batch under ``path``; the same batch again replaces itself.

    So a job that failed half-way is simply run again. Batches are named by letters,
    digits, '-' and '.' alone.
    """
    if not batch or not all(c.isalnum() or c in "-." for c in batch):
        raise ValueError("a batch is named by letters, digits, '-' and '.'")
    state.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def saved_batches(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The states of all batches kept under ``path``, to be merged."""
    states = spark.read.parquet(path).drop("batch")
    return states.select(*columns) if columns else states


def merge_counts(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value counts of all batches as one: ``(*by, value, n)``."""
    return union_of(states).groupBy(*by, "value").agg(F.sum("n").alias("n"))


def version_state(df: DataFrame, keys: Sequence[str], text: str, stored_at: str) -> DataFrame:
    """``(*keys, version, n, first_storetime, latest_storetime)``: one row per note and distinct text.

    ``version`` is the text's SHA-256, null for a missing text, so a state is as small
    as the number of distinct texts however long they are.
    """
    return (
        df.select(*keys, F.sha2(text, 256).alias("version"), F.col(stored_at).alias("_stored"))
        .groupBy(*keys, "version")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_stored").alias("first_storetime"),
            F.max("_stored").alias("latest_storetime"),
        )
    )


def merge_version_states(*states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return union_of(states).groupBy(*keys, "version").agg(
        F.sum("n").alias("n"),
        F.min("first_storetime").alias("first_storetime"),
        F.max("latest_storetime").alias("latest_storetime"),
    )


def version_stats_of(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`version_stats` of the notes in a merged state."""
    total, unique = F.sum("n"), F.count("version")
    return state.groupBy(*keys).agg(
        total.alias("total_versions"),
        unique.alias("unique_text_versions"),
        F.min("first_storetime").alias("first_storetime"),
        F.max("latest_storetime").alias("latest_storetime"),
        (total - unique).alias("exact_duplicates"),
        (total - 1).alias("potential_drafts"),
    )
