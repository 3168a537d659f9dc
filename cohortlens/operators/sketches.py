"""Mergeable summaries of bounded size: quantile (KLL) and distinct (HLL, theta) sketches.

The exact operators stay the default. A sketch is one binary column, made with
partial aggregation, kept beside its group, and merged with those of other files,
days or batches without reading their rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.counts import attach, value_counts
from cohortlens.operators.distributions import QUARTILES

KLL_K = 200
LG_ENTRIES = 12


def rank_error(k: int = KLL_K) -> float:
    """The normalised rank error that a KLL sketch of size ``k`` keeps with 99 % confidence.

    Fixed values of the sketch's published error bound for single ranks.
    """
    return 2.296 / k**0.9021


def distinct_error(lg_entries: int = LG_ENTRIES) -> float:
    """Three standard errors of a distinct sketch with 2^lg_entries entries, as a share of the count."""
    return 3 * 1.04 / 2 ** (lg_entries / 2)


def union_of(states: Sequence[DataFrame]) -> DataFrame:
    if not states:
        raise ValueError("there is nothing to merge")
    return reduce(DataFrame.unionByName, states)


def quantile_sketch(df: DataFrame, col: str, by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """``(*by, n_values, min, max, sketch)`` of the values that are neither null nor NaN.

    A group without a value has no row, so an empty table gives none. Tasks combine
    their rows first, so a group with a third of all rows moves one sketch a task.
    """
    v = F.col(col).cast("double")
    present = df.select(*by, F.nanvl(v, F.lit(None).cast("double")).alias("_v")).filter("_v IS NOT NULL")
    made = present.groupBy(*by).agg(
        F.count("_v").alias("n_values"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"),
    )
    return made.filter("n_values > 0")


def merge_quantile_sketches(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group out of the rows of all ``states``; any order and grouping gives the same bound."""
    merged = union_of(states).groupBy(*by).agg(
        F.sum("n_values").alias("n_values"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    return merged.filter("n_values > 0")


def sketch_quantiles(
    state: DataFrame, probs: Mapping[str, float] = QUARTILES, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, n_values, min, max, *probs)``: values whose ranks lie within :func:`rank_error` of the wanted."""
    return state.select(
        *by,
        "n_values",
        "min",
        "max",
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()],
    )


def quantile_ranks(
    df: DataFrame,
    col: str,
    estimates: DataFrame,
    probs: Mapping[str, float] = QUARTILES,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(*by, prob, estimate, n_values, rank_lo, rank_hi)``: where estimates truly stand.

    ``rank_lo`` is the share of the group's values below the estimate and ``rank_hi``
    the share not above it, over all rows of ``df``. An estimate keeps an error ``e`` if
    ``prob`` lies between ``rank_lo - e`` and ``rank_hi + e``.
    """
    counts = value_counts(df, col, by)
    named = estimates.select(*by, *[F.col(name).alias(f"_{name}") for name in probs])
    v, n = F.col("value").cast("double"), F.col("n")
    sums = attach(counts, named, by).groupBy(*by).agg(
        F.sum(n).alias("n_values"),
        *[F.first(f"_{name}").alias(f"_{name}") for name in probs],
        *[F.sum(F.when(v < F.col(f"_{name}"), n).otherwise(0)).alias(f"_{name}_lo") for name in probs],
        *[F.sum(F.when(v <= F.col(f"_{name}"), n).otherwise(0)).alias(f"_{name}_hi") for name in probs],
    )
    rows = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.col(f"_{name}").alias("estimate"),
            (F.col(f"_{name}_lo") / F.col("n_values")).alias("rank_lo"),
            (F.col(f"_{name}_hi") / F.col("n_values")).alias("rank_hi"),
        )
        for name, p in probs.items()
    ]
    return sums.select(*by, "n_values", F.inline(F.array(*rows))).select(
        *by, "prob", "estimate", "n_values", "rank_lo", "rank_hi"
    )


def distinct_sketch(
    df: DataFrame, col: str, by: Sequence[str] = (), kind: str = "hll", lg_entries: int = LG_ENTRIES
) -> DataFrame:
    """``(*by, n_rows, sketch)`` of the distinct non-null values of ``col``.

    ``kind="hll"`` is the smallest; ``kind="theta"`` also allows differences between
    sketches, and is exact up to its number of entries. Values other than numbers and
    texts must be cast first.
    """
    if kind not in ("hll", "theta"):
        raise ValueError("kind must be 'hll' or 'theta'")
    make = F.hll_sketch_agg if kind == "hll" else F.theta_sketch_agg
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), make(F.col(col), F.lit(lg_entries)).alias("sketch")
    )


def merge_distinct_sketches(*states: DataFrame, by: Sequence[str] = (), kind: str = "hll") -> DataFrame:
    """One row per group out of the rows of all ``states``."""
    merge = F.hll_union_agg("sketch") if kind == "hll" else F.theta_union_agg("sketch", F.lit(LG_ENTRIES))
    return union_of(states).groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), merge.alias("sketch"))


def distinct_estimates(state: DataFrame, by: Sequence[str] = (), kind: str = "hll") -> DataFrame:
    """``(*by, n_rows, n_distinct)``: counts within :func:`distinct_error` of the true ones."""
    estimate = F.hll_sketch_estimate if kind == "hll" else F.theta_sketch_estimate
    return state.select(*by, "n_rows", estimate("sketch").alias("n_distinct"))


def new_values(state: DataFrame, earlier: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_distinct, n_new)`` of theta sketches: values, and those that ``earlier`` does not hold.

    Groups that ``earlier`` lacks hold new values only.
    """
    seen = earlier.select(*by, F.col("sketch").alias("_earlier"))
    if by:
        renamed = seen.withColumnsRenamed({key: f"_right_{key}" for key in by})
        same = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in by]
        both = state.join(renamed, same, "left")
    else:
        both = state.withColumn("_earlier", seen.select("_earlier").scalar())
    n = F.theta_sketch_estimate("sketch")
    new = F.theta_sketch_estimate(F.theta_difference("sketch", "_earlier"))
    return both.select(
        *by, n.alias("n_distinct"), F.when(F.col("_earlier").isNull(), n).otherwise(new).alias("n_new")
    )
