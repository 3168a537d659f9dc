"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
``documents``, and those alone: other columns are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import stored
from cohortlens.llm.crf import identify_languages
from cohortlens.llm.lines import dedup_lines
from cohortlens.llm.mixing import mix, take_copies
from cohortlens.llm.packing import pack
from cohortlens.llm.queries import MIX_WEIGHTS, mix_levels
from cohortlens.llm.simhash import simhash_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_CERTAINTY = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in no known language: no letters, or words that are not surely of any.

    What counts is how surely each word is of some language, so text that switches
    between known languages stays. Null texts have no letters. A missing language is
    filled in; others stay as stated.
    """
    found = identify_languages(docs, carry=[*COLUMNS], spans=False, learn=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("certainty") >= MIN_CERTAINTY))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group; a document of which nothing but white space is left goes with its lines.

    Documents that lose no line stay, those without text included. ``n_chars`` follows
    the text.
    """
    rows = dedup_lines(docs.select(*COLUMNS))
    gone = (F.col("n_dropped") > 0) & (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "")
    rows = rows.filter(~F.coalesce(gone, F.lit(False)))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash group, once if its row is repeated.

    Documents without an id all stay, since no id names the one to keep.
    """
    groups = simhash_components(docs)
    kept = stored(groups.filter("doc_id = component_id").select("doc_id").distinct(), "kept")
    rows = docs.select(*COLUMNS)
    named = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(rows.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf of the mixing tree takes them."""
    mixed = mix(docs, mix_levels(), weights=MIX_WEIGHTS, budget_percent=100)
    return take_copies(docs.select(*COLUMNS), mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a digest of their ids; copies are packed one for one."""
    return pack(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


STAGES = [
    ("language id", identify),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Learned models, graph components and token ids are no matter for SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
