"""WARC archives: written with Spark's text writer, read back by boundary chains.

**Writing.** A record is a UTF-8 string that ends in one CRLF; the text writer's
line separator adds the second. Spark's commit protocol makes each archive whole
or absent, on any file system it can write. Of the records with equal payloads of
at least ``min_revisit`` bytes, the one with the smallest id is a response and the
others are revisits of it.

**Reading.** A payload may hold the magic, or a whole record, so splitting at the
magic is not enough. Archives are read in splits, cut at every occurrence of the
magic. Byte offsets come from prefix sums: of the pieces inside a split, and of
the splits of a file. Each cut is a candidate record, and its header gives the
offset of its successor. Starting at offset zero, pointer jumping doubles the
length of the known chain in every round and keeps the candidates it reaches; all
other cuts lie inside a payload and are joined to the record before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import drop_stored, stored

MAGIC = "WARC/1.1\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A hot payload's rows are dealt to this many tasks when they look up its first record.
SALTS = 64


def _record_id(page_id: Column) -> Column:
    h = F.md5(page_id.cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; line breaks are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def plan_revisits(
    pages: DataFrame, *, page_id: str = "page_id", html: str = "html", min_revisit: int = 100
) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that become revisits; no payloads travel.

    Rows that repeat an id with the same payload get the same decision, so all rows
    of the smallest id are responses. A null id sorts after all others.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.filter(F.octet_length(payload) >= min_revisit).select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.unhex(F.sha2(F.encode(payload, "UTF-8"), 256)).alias("digest"),
    )
    # Only digests that occur more than once are looked up, and each is repeated
    # for every salt, so the rows of a hot one meet it in many tasks.
    first = (
        rows.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 AND refers_to IS NOT NULL")
        .select(
            "digest",
            "refers_to",
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
    )
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        .join(first, ["digest", "salt"])
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit: int = 100,
    records_per_file: int = 10_000,
) -> None:
    """Write a record for each row of ``pages`` to archives under ``path``.

    Null payloads are empty, a null URL leaves its header line out, and an empty
    table writes no record. Rows are kept one for one.
    """
    # Written first, so that its size is known: a small one is joined without a shuffle.
    plan = stored(
        plan_revisits(pages, page_id=page_id, html=html, min_revisit=min_revisit), "revisits"
    ).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").alias("payload_bytes"),
        F.sha2(F.encode("payload", "UTF-8"), 256).alias("digest"),
    )
    # An id belongs to one page, so this join has no hot key; the digest tells repeated ids apart.
    rows = rows.join(
        plan,
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.unhex("digest") == F.col("_digest")),
        "left",
    )
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to").cast("string")))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit("\r\n\r\n"),
        F.col("_block"),
        F.lit("\r\n"),
    )
    (
        rows.withColumn("_block", block)
        .select(record.alias("value"))
        .write.option("lineSep", "\r\n")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text): archives cut at every magic, in the order of the splits."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("text"),
            (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"),
        )
    )


def _with_offsets(cuts: DataFrame) -> DataFrame:
    """``cuts`` with the byte of its file where each text begins, after the magic.

    The text before the first magic of a file has offset zero.
    """
    inside = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    # What a split holds, and where it starts in its file: one row for each split.
    totals = cuts.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start")
    )
    return (
        cuts.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["file", "block"])
        .withColumn("offset", F.col("start") + F.col("before"))
        .drop("block", "at", "before", "start")
    )


def _length(header: Column) -> Column:
    pattern = r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)"
    return F.nullif(F.regexp_extract(header, pattern, 1), F.lit("")).cast("long")


def _parse(rows: DataFrame) -> DataFrame:
    """``rows`` with header, block_bytes, http and payload of the record in ``text``.

    ``block_bytes`` is null where no header ends, or it states no length. The payload
    is what the record's block holds after its HTTP header, as bytes: a candidate need
    not be a record, so the length it states may end anywhere, within a character too.
    """
    end = F.locate("\r\n\r\n", F.col("text"))
    rows = rows.withColumn(
        "header", F.when(end > 0, F.substring_index("text", "\r\n\r\n", 1))
    ).withColumn("block_bytes", _length(F.col("header")))
    rows = rows.withColumn(
        "body", F.expr("substring(cast(text AS binary), octet_length(header) + 5)")
    )
    rows = rows.withColumn("http", F.substring_index(F.col("body").cast("string"), "\r\n\r\n", 1))
    # no text of Spark's is longer than an int can say
    longest = F.lit((1 << 31) - 1)
    stated = F.least(F.greatest(F.col("block_bytes") - F.octet_length("http") - 4, F.lit(0)), longest)
    payload = F.substring(
        F.expr("substring(body, octet_length(http) + 5)"), F.lit(1), stated.cast("int")
    )
    return rows.withColumn("payload", payload).drop("body")


def reachable_records(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from each file's first record.

    ``candidates``: file, offset, successor. Round k knows the first 2**k records of
    every chain and each candidate's 2**k-th successor. A chain ends where the
    successor is no candidate: at the end of the file, or at damage.
    """
    spark = candidates.sparkSession
    jumps = stored(candidates.select("file", "offset", F.col("successor").alias("to")), "jumps")
    places = jumps.select("file", "offset")
    known = stored(places.filter(F.col("offset") == len(MAGIC)), "known")
    while True:
        reached = known.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        more = stored(reached.join(places, ["file", "offset"], "left_semi"), "known")
        if not more.limit(1).count():
            return known
        target = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        doubled = stored(
            jumps.join(target, ["file", "to"], "left").select(
                "file", "offset", F.col("further").alias("to")
            ),
            "jumps",
        )
        drop_stored(spark, jumps)
        known, jumps, places = known.unionByName(more), doubled, doubled.select("file", "offset")


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Every record on the boundary chain of each archive under ``path``.

    Columns: file, offset (of the magic), record_type, page_id, refers_to,
    target_uri, payload_digest (bare hexadecimal), payload_bytes (of the full
    payload, from the HTTP header, so revisits have it too), valid (a response's
    payload has the length and digest stated; null for a revisit), and payload (null
    for a revisit), which ``payloads=False`` leaves out. Bytes of a payload that are not
    UTF-8 read as U+FFFD, while length and digest are those of the bytes. Text after the
    end of a chain is not returned: a truncated or damaged file ends with the record
    before the damage, or the one it cuts, which is then not valid. Archives without
    records give no rows.

    The first pass keeps headers, sizes and payload digests only. Texts are read a
    second time where payloads are wanted, else only in files that have a record
    which the magic cuts.
    """
    first = _parse(_cuts(spark, path))
    exact = F.octet_length("header") + F.col("block_bytes") + 8 == F.octet_length("text")
    pieces = stored(
        _with_offsets(
            first.select(
                "file",
                "block",
                "at",
                "size",
                "header",
                "http",
                "block_bytes",
                F.coalesce(exact, F.lit(False)).alias("exact"),
                F.octet_length("payload").alias("found_bytes"),
                F.sha2("payload", 256).alias("found_digest"),
            )
        ),
        "pieces",
    )
    after = F.col("offset") + F.octet_length("header") + F.col("block_bytes") + 8 + len(MAGIC)
    known = reachable_records(
        pieces.filter("offset > 0").select("file", "offset", after.alias("successor"))
    )
    records = stored(pieces.join(known, ["file", "offset"], "left_semi"), "records")
    cut = records.filter("NOT exact")
    if payloads or cut.limit(1).count():
        texts = _cuts(spark, path)
        if not payloads:
            texts = texts.join(cut.select("file").distinct(), "file", "left_semi")
        whole = _parse(_stitched(_with_offsets(texts), records.select("file", "offset"))).select(
            "file",
            "offset",
            "header",
            "http",
            "payload",
            F.octet_length("payload").alias("found_bytes"),
            F.sha2("payload", 256).alias("found_digest"),
        )
        if not payloads:
            columns = ["file", "offset", "header", "http", "found_bytes", "found_digest"]
            whole = whole.join(cut.select("file", "offset"), ["file", "offset"], "left_semi")
            whole = records.filter("exact").select(columns).unionByName(whole.select(columns))
        records = whole
    field = lambda name: F.nullif(
        F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r]*)", 1), F.lit("")
    )
    revisit = F.col("record_type") == "revisit"
    found = records.select(
        "file",
        (F.col("offset") - len(MAGIC)).alias("offset"),
        field("WARC-Type").alias("record_type"),
        field("X-Page-Id").cast("long").alias("page_id"),
        field("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        _length(F.col("http")).alias("payload_bytes"),
        "found_bytes",
        "found_digest",
        *(["payload"] if payloads else []),
    )
    agrees = (F.col("found_bytes") == F.col("payload_bytes")) & (
        F.col("found_digest") == F.col("payload_digest")
    )
    found = found.withColumn("valid", F.when(~revisit, agrees)).drop("found_bytes", "found_digest")
    if not payloads:
        return found
    text = F.make_valid_utf8(F.col("payload").cast("string"))
    return found.withColumn("payload", F.when(~revisit, text))


def _stitched(cuts: DataFrame, records: DataFrame) -> DataFrame:
    """(file, offset, text) of each record: its own cut and those up to the next record.

    Cuts find their record in the order of their file without their texts.
    """
    upto = W.partitionBy("file").orderBy("offset")
    owned = (
        cuts.select("file", "offset")
        .join(records.withColumn("start", F.col("offset")), ["file", "offset"], "left")
        .withColumn("record", F.last("start", ignorenulls=True).over(upto))
        .filter("record IS NOT NULL")
        .select("file", "offset", "record")
    )
    tails = (
        cuts.join(owned.filter("offset <> record"), ["file", "offset"])
        .groupBy("file", F.col("record").alias("offset"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), "text"))).alias("cuts"))
        .select(
            "file", "offset", F.concat(F.lit(MAGIC), F.array_join("cuts.text", MAGIC)).alias("tail")
        )
    )
    return (
        cuts.select("file", "offset", "text")
        .join(records, ["file", "offset"], "left_semi")
        .join(tails, ["file", "offset"], "left")
        .select("file", "offset", F.concat("text", F.coalesce("tail", F.lit(""))).alias("text"))
    )
