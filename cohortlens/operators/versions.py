"""Repeated versions of the same note."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_stats(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    stored_at: str,
    drop_null_keys: bool = False,
    compare: str = "digest",
) -> DataFrame:
    """Versions, distinct texts and first/last storage time per note.

    Missing texts are not counted as distinct. Texts are compared by their
    SHA-256 digest, so 64 characters travel in the shuffle instead of whole
    notes; ``compare="text"`` shuffles the texts themselves. Either way copies
    are combined by (keys, text) before they are counted by keys, so a note
    with very many copies does not gather in one task.
    """
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    if compare == "digest":
        version = F.sha2(text, 256)
    elif compare == "text":
        version = F.col(text)
    else:
        raise ValueError(f"unknown comparison: {compare}")
    return (
        df.select(*keys, version.alias("_version"), stored_at)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_versions"),
            F.count_distinct("_version").alias("unique_text_versions"),
            F.min(stored_at).alias("first_storetime"),
            F.max(stored_at).alias("latest_storetime"),
        )
        .withColumns(
            {
                "exact_duplicates": F.col("total_versions") - F.col("unique_text_versions"),
                "potential_drafts": F.col("total_versions") - 1,
            }
        )
    )


def version_sizes(
    df: DataFrame, keys: Sequence[str], drop_null_keys: bool = True
) -> DataFrame:
    """Rows per key, without looking at the texts."""
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_versions"))


def size_summary(sizes: DataFrame) -> DataFrame:
    """One row: keys, keys with several versions, most versions of one key."""
    n = F.col("total_versions")
    return sizes.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(n > 1).alias("n_multiple"),
        F.max(n).alias("max_versions"),
    )


def version_summary(stats: DataFrame) -> DataFrame:
    """One row over :func:`version_stats`; the average is rounded half to even."""
    n = F.col("total_versions")
    return stats.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(n > 1).alias("n_multiple"),
        F.max(n).alias("max_versions"),
        F.bround(F.avg(n), 2).alias("avg_versions"),
        F.count_if(F.col("exact_duplicates") > 0).alias("n_exact_duplicates"),
        F.count_if(F.col("potential_drafts") > 0).alias("n_drafts"),
    )


def version_distribution(stats: DataFrame) -> DataFrame:
    """How many notes have each number of versions."""
    return (
        stats.groupBy("total_versions")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("total_versions")
    )


def version_by_category(stats: DataFrame) -> DataFrame:
    """Notes, mean and most versions per category, highest mean first."""
    n = F.col("total_versions")
    return (
        stats.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(n).alias("mean_versions"),
            F.max(n).alias("max_versions"),
        )
        .orderBy(F.desc("mean_versions"), "category")
    )
