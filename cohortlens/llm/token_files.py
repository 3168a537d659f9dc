"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file, from its first byte to its last:

- a header in a skippable frame, of fixed size: where the file stands, and its totals
- independent zstandard frames, each of whole documents' ids (little-endian, two
  bytes wide where all of the file's ids fit, else four), with content checksums
- an index in a skippable frame: each document's id and length, each frame's documents
- the seek table of zstandard's seekable format: for every frame before it its size,
  its decompressed size and the low 32 bits of the XXH64 of its decompressed bytes

So any zstandard tool can decompress a file, and a reader that wants some documents
decompresses their frames alone. Files are Spark's own output: a row is a file, and
the line separator of Spark's text writer is the magic number that ends the format.
Spark's commit decides which attempt of a task counts, on every file system.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.packing import VOCABULARY, Encoder

# Fixed values of zstandard's skippable frames and seekable format.
SKIPPABLE_HEADER = 0x184D2A50
SKIPPABLE_INDEX = 0x184D2A51
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"
CHECKSUM_FLAG = 0x80

# Version, width of an id, task, file of the task, documents, ids, the task's ids before the file.
HEADER = struct.Struct("<4sIqqqqq")
HEADER_NUMBERS = ("task", "number", "n_docs", "n_ids", "before")
VERSION = b"TOK1"
FOOTER = struct.Struct("<IB4s")
ENTRY = np.dtype([("size", "<u4"), ("raw", "<u4"), ("sum", "<u4")])
DOCUMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("frame", "<u4")])
HEADER_BYTES = 8 + HEADER.size

LAYOUT = "doc_id long, start long, n_tokens long, file string, frame int, at long"


class DamagedFile(ValueError):
    """A token file whose bytes do not agree with its tables or checksums."""


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def _sum32(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileBuilder:
    """Gathers documents into frames, and frames into one file's bytes without the last magic."""

    def __init__(self, frame_ids: int, level: int):
        self.frame_ids, self.level = frame_ids, level
        self.frames: list[list[np.ndarray]] = [[]]
        self.in_frame = self.ids = 0
        self.documents: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.in_frame >= self.frame_ids:
            self.frames.append([])
            self.in_frame = 0
        self.frames[-1].append(ids)
        self.in_frame += len(ids)
        self.ids += len(ids)
        self.documents.append((doc_id or 0, doc_id is None, len(ids), len(self.frames) - 1))

    def build(self, task: int, number: int, before: int) -> bytes:
        compress = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress
        wide = any(len(x) and int(x.max()) > 0xFFFF for frame in self.frames for x in frame)
        kind = "<u4" if wide else "<u2"
        header = HEADER.pack(VERSION, 4 if wide else 2, task, number, len(self.documents), self.ids, before)
        parts, entries = [_skippable(SKIPPABLE_HEADER, header)], [(HEADER_BYTES, 0, _sum32(b""))]
        for frame in self.frames:
            raw = np.concatenate(frame).astype(kind).tobytes()
            parts.append(compress(raw))
            entries.append((len(parts[-1]), len(raw), _sum32(raw)))
        documents = np.array(self.documents, dtype=DOCUMENT).tobytes()
        parts.append(_skippable(SKIPPABLE_INDEX, compress(documents)))
        entries.append((len(parts[-1]), 0, _sum32(b"")))
        table = np.array(entries, dtype=ENTRY).tobytes()
        footer = FOOTER.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        # the writer's line separator adds the magic
        parts.append(_skippable(SKIPPABLE_SEEK_TABLE, table + footer)[: -len(SEEKABLE_MAGIC)])
        return b"".join(parts)


class FileReader:
    """One file's tables, checked; its frames are decompressed only when asked for."""

    def __init__(self, data: bytes, name: str = "file"):
        self.data, self.name = data, name
        try:
            frames, flag, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
            size = frames * ENTRY.itemsize + FOOTER.size
            begin = len(data) - size - 8
            if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG or begin < 0:
                raise DamagedFile(f"{name}: no seek table at its end")
            if struct.unpack_from("<II", data, begin) != (SKIPPABLE_SEEK_TABLE, size):
                raise DamagedFile(f"{name}: its seek table does not fit its frame")
            self.entries = np.frombuffer(data, ENTRY, frames, begin + 8)
            self.ends = np.cumsum(self.entries["size"], dtype=np.int64)
            if frames < 2 or self.ends[-1] != begin or self.entries["size"][0] != HEADER_BYTES:
                raise DamagedFile(f"{name}: its frames do not fill it")
            version, self.width, self.task, self.number, n, self.ids, self.before = HEADER.unpack_from(data, 8)
            if version != VERSION or self.width not in (2, 4):
                raise DamagedFile(f"{name}: its header is of no known version")
            at = int(self.ends[-2]) + 8
            tables = zstandard.ZstdDecompressor().decompress(data[at : int(self.ends[-1])])
            self.documents = np.frombuffer(tables, DOCUMENT)
            if len(self.documents) != n or int(self.documents["n"].sum(dtype=np.int64)) != self.ids:
                raise DamagedFile(f"{name}: its index does not fit its header")
        except (struct.error, zstandard.ZstdError, ValueError) as fault:
            raise fault if isinstance(fault, DamagedFile) else DamagedFile(f"{name}: {fault}") from fault
        # ids of the file before each document, and of its frame
        self.places = np.cumsum(self.documents["n"], dtype=np.int64) - self.documents["n"]
        first = np.searchsorted(self.documents["frame"], self.documents["frame"])
        self.at = self.places - self.places[first] if n else self.places

    def frame(self, number: int) -> np.ndarray:
        """The ids of the frame with this number, counted from 0, as unsigned 32-bit."""
        entry, end = self.entries[number + 1], int(self.ends[number + 1])
        try:
            raw = zstandard.ZstdDecompressor().decompress(self.data[end - int(entry["size"]) : end])
        except zstandard.ZstdError as fault:
            raise DamagedFile(f"{self.name}, frame {number}: {fault}") from fault
        if len(raw) != entry["raw"] or _sum32(raw) != entry["sum"]:
            raise DamagedFile(f"{self.name}, frame {number}: its bytes do not fit its checksum")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _doc_id(value: object) -> int | None:
    return None if value is None else int(value)


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = 0,
    vocabulary: str = VOCABULARY,
    frame_ids: int = 16_384,
    file_ids: int = 4_000_000,
    level: int = 3,
) -> None:
    """Write the ids of every text to ``path``, in ascending order of ``doc_id``.

    Ids are those of ``tokenizers`` without special tokens, and ``end_id`` ends every
    document, so a null or empty text is that id alone. Null ids come last, and rows
    of one id keep their input order. A frame closes once it holds ``frame_ids`` ids and
    a file once it holds ``file_ids``; a document is never cut, so a longer one makes a
    longer frame. An empty table makes a folder without documents. Other columns are
    not read.

    Rows are dealt by ranges of (id, input position), so an id that many rows share is
    spread like any other rows.
    """

    def encode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = Encoder(vocabulary), TaskContext.get().partitionId()
        number = before = 0
        file = FileBuilder(frame_ids, level)
        for batch in batches:
            for key, words in zip(batch["id"], batch["text"]):
                ids = encode(words) if words else np.zeros(0, "<u4")
                file.add(_doc_id(key), np.append(ids, np.uint32(end_id)).astype("<u4"))
                if file.ids >= file_ids:
                    yield pd.DataFrame({"content": [file.build(task, number, before)]})
                    number, before = number + 1, before + file.ids
                    file = FileBuilder(frame_ids, level)
        if file.documents:
            yield pd.DataFrame({"content": [file.build(task, number, before)]})

    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = rows.orderBy(F.asc_nulls_last("id"), "row")
    # ids go through pandas as text, since pandas garbles long ones beside a null
    files = ordered.select(F.col("id").cast("string"), "text").mapInPandas(encode_files, "content binary")
    (
        files.select(F.col("content").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", SEEKABLE_MAGIC.decode("ISO-8859-1"))
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files at ``path`` that hold documents."""
    found = spark.read.format("binaryFile").load(path)
    return found.filter("length > 0").select("path", "content")


def _numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [HEADER.unpack(x)[2:] for x in batch["head"]]
        fields = pd.DataFrame(rows, columns=HEADER_NUMBERS, dtype="int64")
        yield pd.concat([batch[["path"]].reset_index(drop=True), fields], axis=1)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, task, number, n_docs, n_ids, before) of every file, from its first bytes alone."""
    head = F.substring("content", 9, HEADER.size)
    kinds = ", ".join(f"{n} long" for n in HEADER_NUMBERS)
    return _files(spark, path).select("path", head.alias("head")).mapInPandas(_numbers, f"path string, {kinds}")


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each writing task's first file: one number for each task that wrote."""
    ends = file_headers(spark, path).groupBy("task").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    bases, place = {}, 0
    for task, n in sorted(tuple(r) for r in ends.collect()):
        bases[task], place = place, place + n
    return bases


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ``start`` counts the ids of all before it.

    ``ids`` is little-endian unsigned 32-bit. Files are checked against their tables and
    checksums, and a damaged one stops the job with :class:`DamagedFile`.
    """
    shared = spark.sparkContext.broadcast(_bases(spark, path))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                file = FileReader(content, name)
                base = shared.value[file.task] + file.before
                of_frame = file.documents["frame"]
                for number in range(len(file.entries) - 2):
                    ids = file.frame(number)
                    a, b = np.searchsorted(of_frame, [number, number + 1])
                    rows, at = file.documents[a:b], file.at[a:b]
                    yield pd.DataFrame(
                        {
                            "doc_id": [None if r["null"] else str(r["id"]) for r in rows],
                            "start": base + file.places[a:b],
                            "n_tokens": rows["n"].astype(np.int64),
                            "ids": [ids[i : i + n].tobytes() for i, n in zip(at, rows["n"])],
                        }
                    )

    found = _files(spark, path).mapInPandas(decode, "doc_id string, start long, n_tokens long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every document is: doc_id, start, n_tokens, file, frame, and its place in the frame.

    No frame of ids is decompressed.
    """
    shared = spark.sparkContext.broadcast(_bases(spark, path))

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                file = FileReader(content, name)
                rows = file.documents
                yield pd.DataFrame(
                    {
                        "doc_id": [None if r["null"] else str(r["id"]) for r in rows],
                        "start": shared.value[file.task] + file.before + file.places,
                        "n_tokens": rows["n"].astype(np.int64),
                        "file": name,
                        "frame": rows["frame"].astype(np.int32),
                        "at": file.at,
                    }
                )

    found = _files(spark, path).mapInPandas(lay_out, LAYOUT.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of :func:`read_tokens` whose id is in ``wanted`` (doc_id); only their frames are decompressed.

    Null ids match nothing. A wanted id that many documents have gives all of them.
    Damage outside the frames that are read goes unnoticed.
    """
    index = token_index(spark, path).join(wanted.select("doc_id"), "doc_id", "left_semi")
    # at most as many as a file has documents
    lists = index.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("frame", "at", "n_tokens", "start", "doc_id"))).alias("rows")
    )

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, rows in zip(batch["path"], batch["content"], batch["rows"]):
                file, number, ids = FileReader(content, name), -1, None
                found = []
                for row in rows:
                    if row["frame"] != number:
                        number = row["frame"]
                        ids = file.frame(number)
                    at, n = row["at"], row["n_tokens"]
                    found.append((row["doc_id"], row["start"], n, ids[at : at + n].tobytes()))
                yield pd.DataFrame(found, columns=["doc_id", "start", "n_tokens", "ids"])

    files = _files(spark, path).join(lists.withColumnRenamed("file", "path"), "path")
    return files.mapInPandas(pick, "doc_id long, start long, n_tokens long, ids binary")
