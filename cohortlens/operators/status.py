"""Care-status timelines: first, last and ever-charted status per stay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import classify_flags, text_flags
from cohortlens.operators.relations import dealt
from cohortlens.operators.sketches import union_of

STAY_KEYS = ("subject_id", "hadm_id", "icustay_id", "intime")


def timeline_state(
    events: DataFrame,
    itemids: Sequence[int],
    mapping: Mapping[str, Sequence[str]],
    ignored_texts: Sequence[str] = (),
    error_col: str = "error",
    tie_breakers: Sequence[str] = ("value",),
) -> DataFrame:
    """``(icustay_id, first, last, *flags, *_first_charttime)`` of the stays with status events.

    Events are ordered by chart time, a missing time last, then by ``tie_breakers``.
    Events marked as errors are left out. ``first`` and ``last`` are minimum and maximum
    of one ordered struct, which combine on the map side, where row-number windows
    would sort all events of a stay. They also merge: :func:`merge_timeline_states`.
    """
    names = list(mapping)
    error = F.col(error_col)
    flagged = events.filter(
        F.col("itemid").isin(*itemids)
        & F.col("value").isNotNull()
        & ~F.col("value").isin(*ignored_texts)
        & (error.isNull() | (error == 0))
        & F.col("icustay_id").isNotNull()
    ).select("icustay_id", "charttime", *tie_breakers, *_aliased(text_flags(F.col("value"), mapping)))

    moment = F.struct(
        F.col("charttime").isNull().alias("undated"), "charttime", *tie_breakers, *names
    )
    return flagged.groupBy("icustay_id").agg(
        F.min(moment).alias("first"),
        F.max(moment).alias("last"),
        *[F.max(name).alias(name) for name in names],
        *[
            F.min(F.when(F.col(name) == 1, F.col("charttime"))).alias(f"{name}_first_charttime")
            for name in names
        ],
    )


def merge_timeline_states(*states: DataFrame, flags: Sequence[str]) -> DataFrame:
    """The state of all batches' events: late events may come in any batch and order."""
    return union_of(states).groupBy("icustay_id").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        *[F.max(name).alias(name) for name in flags],
        *[F.min(f"{name}_first_charttime").alias(f"{name}_first_charttime") for name in flags],
    )


def timeline_of(stays: DataFrame, state: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row per stay: each flag first, last, ever, and the time it was first set.

    Stays without events have null flags.
    """
    return (
        dealt(stays.select(*STAY_KEYS), "icustay_id")
        .distinct()
        .join(state, "icustay_id", "left")
        .select(
            *STAY_KEYS,
            *[F.col(f"first.{name}").alias(f"{name}_first") for name in flags],
            *[F.col(f"last.{name}").alias(f"{name}_last") for name in flags],
            *flags,
            *[f"{name}_first_charttime" for name in flags],
        )
    )


def status_timeline(
    stays: DataFrame,
    events: DataFrame,
    itemids: Sequence[int],
    mapping: Mapping[str, Sequence[str]],
    ignored_texts: Sequence[str] = (),
    error_col: str = "error",
    tie_breakers: Sequence[str] = ("value",),
) -> DataFrame:
    """:func:`timeline_of` the stays and the :func:`timeline_state` of the events.

    The events of a stay are reduced before the shuffle and before the join.
    """
    state = timeline_state(events, itemids, mapping, ignored_texts, error_col, tie_breakers)
    return timeline_of(stays, state, list(mapping))


def _aliased(columns: Mapping) -> list:
    return [column.alias(name) for name, column in columns.items()]


def classify_status(df: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Adds ``status``: the first flag of ``priority`` set at the end of the stay."""
    return df.withColumn(
        "status", classify_flags({name: F.col(f"{name}_last") for name in priority})
    )


def status_per_admission(df: DataFrame) -> DataFrame:
    """``(hadm_id, status)``: the status of the admission's latest stay."""
    return df.groupBy("hadm_id").agg(
        F.max_by("status", F.struct("intime", "icustay_id")).alias("status")
    )
