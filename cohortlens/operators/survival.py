"""Kaplan-Meier survival curves."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kaplan_meier(
    df: DataFrame,
    duration: str,
    event: str | None = None,
    by: Sequence[str] = (),
    ci: bool = False,
    alpha: float = 0.05,
) -> DataFrame:
    """Product-limit survival estimate per group, one row per distinct duration.

    ``event`` is 1 where the end was observed and 0 where it was censored;
    without it all ends count as observed. Rows without a duration are left out.
    ``ci`` adds the log-log confidence limits, null where survival is 0 or 1.

    Durations are counted first, on the map side, and the windows run over the
    counts: at most one row per whole day of follow-up in a group.
    """
    observed = F.col(event).cast("long") if event else F.lit(1)
    exits = (
        df.filter(F.col(duration).isNotNull())
        .groupBy(*by, F.col(duration).alias("t"))
        .agg(F.coalesce(F.sum(observed), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("_left"))
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    upto = group.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    at_risk = exits.withColumn(
        "at_risk",
        F.sum("_left").over(group) - F.coalesce(F.sum("_left").over(earlier), F.lit(0)),
    )
    curve = at_risk.withColumn(
        "survival", F.product(F.lit(1.0) - F.col("events") / F.col("at_risk")).over(upto)
    )
    columns = [*by, "t", "at_risk", "events", "survival"]
    if not ci:
        return curve.select(*columns)

    d, n, s = F.col("events"), F.col("at_risk"), F.col("survival")
    greenwood = F.sum(F.try_divide(d, n * (n - d))).over(upto)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    inner = (s > 0) & (s < 1)
    theta = F.lit(z) * F.sqrt(greenwood) / F.abs(F.ln(s))
    return curve.withColumn("_theta", F.when(inner, theta)).select(
        *columns,
        F.pow(s, F.exp("_theta")).alias("lower"),
        F.pow(s, F.exp(-F.col("_theta"))).alias("upper"),
    )
