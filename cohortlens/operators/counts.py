"""Value counts, and running positions over them.

Exact distributions are computed from one compressed table: how often each
distinct value occurs in each group. Building it combines on the map side, so a
value or group holding a third of all rows costs one row per task. Everything
after that works on distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_END_OF_TIME = "9999-12-31 23:59:59.999999"


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), keep_missing: bool = False
) -> DataFrame:
    """``(*by, value, n)``: number of rows per group and distinct value.

    Null and NaN are missing and left out, unless ``keep_missing`` asks for one
    row of them per group.
    """
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        v = F.nanvl(v, F.lit(None).cast("double"))
    picked = df.select(*by, v.alias("value"))
    if not keep_missing:
        picked = picked.filter(F.col("value").isNotNull())
    return picked.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join under which a null key equals a null key, as in GROUP BY.

    The right keys are renamed first: both sides often come from one table, and
    renaming keeps the two apart.
    """
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    cond = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    return left.join(renamed, cond, how).drop(*[f"_right_{key}" for key in keys])


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``stats`` (one row per group) to every row of its group.

    With no groups ``stats`` is a single row and enters as a scalar subquery, so
    no cross join is planned.
    """
    if by:
        return join_groups(df, stats, by)
    row = stats.select(F.struct(*stats.columns).alias("row")).scalar()
    return df.withColumn("_row", row).select(
        *df.columns, *[F.col(f"_row.{c}").alias(c) for c in stats.columns]
    )


def slice_offsets(
    sliced: DataFrame, n: str, slice_col: str, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, slice, slice_n, before, total)``: where each slice of a group starts.

    A slice is a coarse value that rises with the value itself. A running sum
    over a whole group would bring all of it to one task; summing slices first
    leaves at most one row per slice, and the sums inside slices run apart.
    """
    group = Window.partitionBy(*by)
    in_order = group.orderBy(F.col(slice_col).asc_nulls_last())
    totals = sliced.groupBy(*by, slice_col).agg(F.sum(n).alias("slice_n"))
    return totals.select(
        *by,
        slice_col,
        "slice_n",
        (F.sum("slice_n").over(in_order) - F.col("slice_n")).alias("before"),
        F.sum("slice_n").over(group).alias("total"),
    )


def _stand_in(kind: str) -> Column:
    """Some value of the type, to stand where a key is null."""
    if kind == "string":
        return F.lit("")
    if kind == "date" or kind.startswith("timestamp"):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(0).cast(kind)


def with_dense_rank(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    name: str,
    slice_of: Callable[[Column], Column] = lambda time: F.trunc(F.to_date(time), "month"),
) -> DataFrame:
    """Adds the dense rank of each row's time in its group; a missing time ranks last.

    A distributed scan: rows are dealt by group and slice of time (a month), ranked
    inside it, and moved up by what the group's earlier slices hold. So no task sorts
    a whole group, however large it is or whether its key is null. The totals are
    taken where the rows already lie, and the offsets, one narrow row for each slice
    but a group's first, come to them: the rows are shuffled once and never joined
    back to themselves. ``slice_of`` may cut finer; it must never fall as time rises.

    A slice depends on the row alone, not on sampled bounds, so that the totals and
    the rows agree even if a lost executor makes Spark compute either again. Rows of
    one group and slice meet in one task; rows without a time are dealt by their
    content, since they all rank alike.
    """
    kinds = dict(df.dtypes)
    if any(kinds[key].split("<")[0] in ("array", "struct", "binary", "boolean") for key in by):
        keys = {f"_key{i}": F.coalesce(F.col(key).cast("string"), F.lit("")) for i, key in enumerate(by)}
    else:
        keys = {f"_key{i}": F.coalesce(key, _stand_in(kinds[key])) for i, key in enumerate(by)}
    keys |= {f"_missing{i}": F.col(key).isNull() for i, key in enumerate(by)}
    undated = F.col(order).isNull()
    dealt = df.withColumns(
        {
            **keys,
            "_slice": F.coalesce(slice_of(F.col(order)), slice_of(F.lit(_END_OF_TIME).cast("timestamp_ntz"))),
            "_salt": F.when(undated, F.pmod(F.xxhash64(*df.columns), F.lit(64)) + 1).otherwise(F.lit(0)),
        }
    )
    part = [*keys, "_slice", "_salt"]
    ranked = dealt.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*part).orderBy(order)))
    # Always true. It reads every column, so that totals and rows share one shuffle
    # instead of computing the input twice.
    same = F.xxhash64(*dealt.columns).bitwiseOR(F.lit(1)) != 0
    distinct = F.max(F.when(F.col("_salt") == 0, F.col("_rank")).otherwise(0))
    totals = ranked.filter(same).groupBy(*part).agg(distinct.alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice", "_salt")
    offsets = totals.select(*part, (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    placed = ranked.join(offsets.filter("_before > 0"), part, "left")
    return placed.select(*df.columns, (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias(name))
