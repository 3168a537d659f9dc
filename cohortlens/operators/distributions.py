"""Exact quantiles, summaries, histograms, densities and box-plot statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import bin_index
from cohortlens.operators.counts import attach, join_groups, slice_offsets, value_counts

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _value_slice(v: Column) -> Column:
    """Coarse value that never falls as ``v`` rises.

    Steps are about 0.0002 near zero and 0.02 % further out, and all doubles
    together fall into fewer than six million slices.
    """
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 4096)).cast("long")


def quantiles(
    counts: DataFrame, probs: Mapping[str, float] = QUARTILES, by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group of a value-count table.

    Rank by rank: the slice totals say which slices hold the wanted ranks, and
    only those slices are put in order.
    """
    sliced = counts.withColumn("_slice", _value_slice(F.col("value").cast("double")))
    offsets = slice_offsets(sliced, "n", "_slice", by)
    position = {
        name: (F.col("total") - 1) * F.lit(float(p)) for name, p in probs.items()
    }
    low = {name: F.floor(pos) for name, pos in position.items()}
    high = {name: F.ceil(pos) for name, pos in position.items()}

    wanted = F.lit(False)
    for rank in [*low.values(), *high.values()]:
        wanted = wanted | (
            (rank >= F.col("before")) & (rank < F.col("before") + F.col("slice_n"))
        )
    hit = offsets.filter(wanted).select(*by, "_slice", "before", "total")

    in_slice = Window.partitionBy(*by, "_slice").orderBy("value")
    placed = join_groups(sliced, hit, [*by, "_slice"]).select(
        *by,
        F.col("value").cast("double").alias("value"),
        "n",
        "total",
        (F.col("before") + F.sum("n").over(in_slice)).alias("_end"),
    )

    def value_at(rank: Column) -> Column:
        start = F.col("_end") - F.col("n")
        return F.max(F.when((rank >= start) & (rank < F.col("_end")), F.col("value")))

    ends = placed.groupBy(*by).agg(
        F.max("total").alias("total"),
        *[value_at(low[name]).alias(f"_{name}_low") for name in probs],
        *[value_at(high[name]).alias(f"_{name}_high") for name in probs],
    )
    return ends.select(
        *by,
        *[
            (
                F.col(f"_{name}_low")
                + (F.col(f"_{name}_high") - F.col(f"_{name}_low"))
                * (position[name] - low[name])
            ).alias(name)
            for name in probs
        ],
    )


def describe_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`describe_numeric` for data already reduced to value counts."""
    v, n = F.col("value").cast("double"), F.col("n")
    first = counts.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    centred = attach(counts, first.select(*by, "n_values", "mean"), by)
    spread = centred.groupBy(*by).agg(
        F.sqrt(
            F.try_divide(
                F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))),
                F.max("n_values") - 1,
            )
        ).alias("std")
    )
    merged = attach(attach(first, spread, by), quantiles(counts, QUARTILES, by), by)
    return merged.select(*by, "n_values", "mean", "std", "min", "q1", "median", "q3", "max")


def describe_numeric(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per group."""
    return describe_counts(value_counts(df, col, by), by)


def _fill_bins(
    binned: DataFrame, by: Sequence[str], nbins: int, lo: Column, width: Column
) -> DataFrame:
    """All ``nbins`` bins of every group with their edges, empty ones as zero."""
    packed = binned.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_bins")
    )
    return packed.select(
        *by,
        "_bins",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nbins - 1).cast("long"))).alias("bin"),
    ).select(
        *by,
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        (lo + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.try_element_at("_bins", F.col("bin")), F.lit(0)).alias("n"),
    )


def histogram_fixed(
    df: DataFrame, col: str, lo: float, width: float, nbins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Histogram over stated edges; the last bin is closed, values outside are left out."""
    low, step, v = F.lit(float(lo)), F.lit(float(width)), F.col(col)
    binned = (
        df.filter((v >= lo) & (v <= lo + nbins * width))
        .select(*by, bin_index(v, low, step, nbins).cast("long").alias("bin"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _fill_bins(binned, by, nbins, low, step)


def histogram_auto_counts(
    counts: DataFrame, nbins: int, by: Sequence[str] = ()
) -> DataFrame:
    """:func:`histogram_auto` for data already reduced to value counts."""
    v = F.col("value").cast("double")
    flat = F.min(v) == F.max(v)
    # Every count is positive. Reading it here keeps the column, so that both
    # uses of the counts share one shuffle instead of reading the source twice.
    ranges = counts.filter(F.col("n") > 0).groupBy(*by).agg(
        F.when(flat, F.min(v) - 0.5).otherwise(F.min(v)).alias("_lo"),
        F.when(flat, F.max(v) + 0.5).otherwise(F.max(v)).alias("_hi"),
    )
    low, step = F.col("_lo"), (F.col("_hi") - F.col("_lo")) / nbins
    binned = (
        attach(counts, ranges, by)
        .withColumn("bin", bin_index(v, low, step, nbins).cast("long"))
        .groupBy(*by, "_lo", "_hi", "bin")
        .agg(F.sum("n").alias("n"))
    )
    return _fill_bins(binned, [*by, "_lo", "_hi"], nbins, low, step).drop("_lo", "_hi")


def histogram_auto(
    df: DataFrame, col: str, nbins: int, by: Sequence[str] = ()
) -> DataFrame:
    """``nbins`` equal bins over each group's own minimum to maximum.

    A group whose values are all equal gets a range of one around the value.
    """
    return histogram_auto_counts(value_counts(df, col, by), nbins, by)


def density_2d(
    df: DataFrame, x: str, y: str, x_width: float, y_width: float
) -> DataFrame:
    """Rows per cell of a grid, for drawing many overlapping points."""
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            F.floor(F.col(x) / F.lit(float(x_width))).alias("x_bin"),
            F.floor(F.col(y) / F.lit(float(y_width))).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(
    df: DataFrame, col: str, by: Sequence[str] = (), whis: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers and outlier count per group.

    A whisker is the furthest value within ``whis`` interquartile ranges of the
    box, and never inside the box.
    """
    counts = value_counts(df, col, by)
    v, n = F.col("value").cast("double"), F.col("n")
    reach = (F.col("q3") - F.col("q1")) * whis
    boxed = attach(counts, quantiles(counts, QUARTILES, by), by)
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    quartiles = ["q1", "median", "q3"]
    whiskers = boxed.groupBy(*by, *quartiles).agg(
        F.sum(n).alias("n"),
        F.min(F.when(inside, v)).alias("_lowest"),
        F.max(F.when(inside, v)).alias("_highest"),
        F.sum(F.when(inside, 0).otherwise(n)).alias("n_outliers"),
    )
    return whiskers.select(
        *by,
        "n",
        *quartiles,
        F.least("_lowest", "q1").alias("lo_whisker"),
        F.greatest("_highest", "q3").alias("hi_whisker"),
        "n_outliers",
    )
