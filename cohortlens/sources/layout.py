"""Tables written for how they will be read: bucketed for joins, clustered for filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.tables import load_tables


def save_bucketed(
    df: DataFrame, name: str, buckets: int, by: Sequence[str], sort_by: Sequence[str] = (), **options: str
) -> DataFrame:
    """Write a catalogue table in ``buckets`` by the hash of ``by``, and read it back.

    Tables of one number of buckets on one key join and aggregate on that key without
    a shuffle. Rows are dealt to their buckets before they are written, so that each
    bucket is one file, sorted by ``sort_by`` (the key, unless stated). Choose so many
    buckets that one fits a task. One key's rows are one bucket's: keep plain tables for
    keys that may hold a large share of all rows, where adaptive execution splits joins.
    """
    writer = df.repartition(buckets, *by).write.mode("overwrite").options(**options)
    writer.bucketBy(buckets, *by).sortBy(*(sort_by or by)).saveAsTable(name)
    return df.sparkSession.table(name)


def save_clustered(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    bloom: Sequence[str] = (),
    files: int | None = None,
    row_group_bytes: int = 32 * 1024 * 1024,
) -> DataFrame:
    """Write Parquet in ranges of ``by``, sorted, with Bloom filters on ``bloom``; read it back.

    A filter on the leading columns then skips files and row groups by their minima
    and maxima, and an equality or IN list on a ``bloom`` column skips row groups whose
    range holds a value that none of their rows has. Ranges are cut by sampled sizes, so
    a value with a third of all rows fills several files if ``by`` goes on with a column
    that tells its rows apart, such as a time.
    """
    count = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(count, *by).sortWithinPartitions(*by)
    writer = ordered.write.mode("overwrite").option("parquet.block.size", str(row_group_bytes))
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def convert_tables(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str = "csv",
    tables: Iterable[str] | None = None,
    options: Mapping[str, str] | None = None,
    clusters: Mapping[str, Sequence[str]] | None = None,
    bad_values: str = "null",
) -> dict[str, DataFrame]:
    """Read tables once from ``source`` and keep them under ``target`` as Parquet.

    What Spark cannot split, such as compressed files or notes that run over several
    lines, is read by one task a file this once, and in parallel from then on.
    ``clusters`` names the columns by which a table's files are sorted.
    """
    clusters = clusters or {}
    for name, df in load_tables(spark, source, fmt, tables, options, bad_values=bad_values).items():
        path = f"{target}/{name}.parquet"
        if name in clusters:
            save_clustered(df, path, clusters[name])
        else:
            df.write.mode("overwrite").parquet(path)
    return load_tables(spark, target, tables=tables)
