"""Semi, anti and lookup joins, latest rows and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _on(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


# Tasks a core that `dealt` makes at least.
TASKS_PER_CORE = 8


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as the session has shuffle partitions.

    Adaptive execution joins small partitions until there is one to a core, so that what
    a task sorts and hashes grows with the input long before there are more tasks. It
    leaves alone a number that is asked for, and gives it to the joins and groups by
    these keys that follow.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * cores)
    return df.repartition(n, *keys)


def keep_by(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other``; a null key occurs nowhere."""
    return df.join(other.select(*_on(on)).distinct(), _on(on), "left_semi")


def exclude_by(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``; rows with a null key stay."""
    return df.join(other.select(*_on(on)).distinct(), _on(on), "left_anti")


def not_in(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """SQL ``on NOT IN (SELECT on FROM other)``, null rules included.

    A null in ``other`` leaves no row, and a null key survives only an empty
    ``other``. Spark's own null-aware anti join always broadcasts the subquery,
    whatever its size. Here its nulls and emptiness are counted apart, and an
    ordinary anti join, which may shuffle, does the rest.
    """
    seen = other.select(
        F.struct(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(on).isNull()).alias("n_null")
        )
    ).scalar()
    passes = (seen["n_null"] == 0) & (F.col(on).isNotNull() | (seen["n_rows"] == 0))
    return exclude_by(df.filter(passes), other.filter(F.col(on).isNotNull()), on)


def lookup_with_default(
    df: DataFrame, lookup: DataFrame, on: str | Sequence[str], col: str, default: str
) -> DataFrame:
    """``col`` of ``lookup`` (one row per key) added to each row, ``default`` without one."""
    return df.join(lookup.select(*_on(on), col), _on(on), "left").withColumn(
        col, F.coalesce(col, F.lit(default))
    )


def latest_per_key(
    df: DataFrame,
    key: str,
    order_by: str,
    ties: bool = True,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Rows with the greatest ``order_by`` of their key; null never counts.

    With ``ties`` all rows at that time are kept; without, the one greatest in
    ``tie_breakers``. Both reduce by key on the map side before any shuffle,
    where a rank window would sort every row of a key in one task.
    """
    if ties:
        latest = df.groupBy(key).agg(F.max(order_by).alias(order_by))
        return df.join(latest, [key, order_by], "left_semi")
    timed = df.filter(F.col(order_by).isNotNull() & F.col(key).isNotNull())
    rest = [c for c in df.columns if c not in (key, order_by, *tie_breakers)]
    best = timed.groupBy(key).agg(
        F.max(F.struct(order_by, *tie_breakers, *rest)).alias("_best")
    )
    return best.select(key, "_best.*").select(*df.columns)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows picked by a seeded hash of the key: random-looking, repeatable."""
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(ticket, key).limit(n)
