"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only in a local session, as in tests, may that be unset: a folder of this machine
    is then made and set for the session. On a cluster each executor would write to a
    disk of its own, so it is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    It cuts the lineage: a lost executor costs the tasks that read it, not the
    work before it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of :func:`stored` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null text."""
    split = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return F.filter(split, lambda word: word != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def longs_as_text(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with those of ``names`` that are longs as text, for a pandas function to carry along.

    Pandas turns integers beside a null into doubles, which garble those above 2^53.
    :func:`longs_again` turns them back.
    """
    return df.withColumns(
        {n: F.col(f"`{n}`").cast("string") for n, kind in df.dtypes if kind == "bigint" and n in names}
    )


def longs_again(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns that are longs in ``like`` as longs again."""
    longs = {n for n, kind in like.dtypes if kind == "bigint"}
    return df.withColumns(
        {n: F.col(f"`{n}`").cast("long") for n, kind in df.dtypes if kind == "string" and n in longs}
    )
