"""Coded titles gathered per admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.counts import join_groups, slice_offsets


def _counted(codes: DataFrame, dictionary: DataFrame, key: str, code: str, title: str) -> DataFrame:
    return (
        codes.select(key, code)
        .join(dictionary.select(code, title), code)
        .groupBy(key, F.col(title).alias("title"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )


def titles_per_group(
    codes: DataFrame,
    dictionary: DataFrame,
    key: str,
    sep: str,
    distinct: bool = True,
    code: str = "icd9_code",
    title: str = "long_title",
) -> DataFrame:
    """``(key, titles)``: the titles of a key's codes in order, joined by ``sep``.

    Titles are counted per key before they are gathered, so what reaches one
    task for one key is bounded by the dictionary. With ``distinct=False`` a
    title is written as often as it was coded.
    """
    counted = _counted(codes, dictionary, key, code, title)
    text = F.col("title")
    if not distinct:
        text = F.array_join(F.array_repeat("title", F.col("n")), sep)
    entry = F.when(F.col("title").isNotNull(), F.struct("title", text.alias("text")))
    gathered = counted.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    # A key whose titles are all missing keeps its row, with no titles.
    joined = F.array_join(F.col("_entries.text"), sep)
    return gathered.select(key, F.when(F.size("_entries") > 0, joined).alias("titles"))


def titles_in_chunks(
    codes: DataFrame,
    dictionary: DataFrame,
    key: str,
    sep: str,
    distinct: bool = True,
    per_chunk: int = 1000,
    code: str = "icd9_code",
    title: str = "long_title",
) -> DataFrame:
    """``(key, chunk, n, titles)``: the ordered titles of a key, ``per_chunk`` to a row.

    The chunks of a key, put together by ``sep`` in the order of their numbers (from
    0), are the text of :func:`titles_per_group`. No row or list holds more than
    ``per_chunk`` titles, however often a key is coded: each title's place is the sum
    over slices (a title's first letters) before its own, and a running sum inside that
    slice; a title with many copies is cut where chunks end. Missing titles have no
    place, so a key with nothing else has no chunk.
    """
    counted = _counted(codes, dictionary, key, code, title).filter("title IS NOT NULL")
    if distinct:
        counted = counted.withColumn("n", F.lit(1))
    sliced = counted.withColumn("_slice", F.substring("title", 1, 2))
    before = slice_offsets(sliced, "n", "_slice", [key]).select(key, "_slice", "before")
    in_slice = Window.partitionBy(key, "_slice").orderBy("title")
    placed = join_groups(sliced, before, [key, "_slice"]).select(
        key,
        "title",
        (F.col("before") + F.sum("n").over(in_slice) - F.col("n")).alias("_from"),
        (F.col("before") + F.sum("n").over(in_slice)).alias("_to"),
    )
    first, last = F.floor(F.col("_from") / per_chunk), F.floor((F.col("_to") - 1) / per_chunk)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("chunk")).select(
        key,
        "chunk",
        "title",
        (
            F.least("_to", (F.col("chunk") + 1) * per_chunk)
            - F.greatest("_from", F.col("chunk") * per_chunk)
        )
        .cast("int")
        .alias("n"),
    )
    gathered = pieces.groupBy(key, "chunk").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("title", "n"))).alias("_titles")
    )
    written = F.transform("_titles", lambda t: F.array_join(F.array_repeat(t["title"], t["n"]), sep))
    return gathered.select(key, "chunk", "n", F.array_join(written, sep).alias("titles"))
