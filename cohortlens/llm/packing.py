"""Concatenate and cut: tokenized documents as one stream, in windows of fixed length.

Pass one tokenizes each document once, and writes its ids with its place inside
its partition. The partitions' token totals, one number for each, give every
partition its place in the stream. Pass two adds the two places and cuts each
document at the window bounds; it reads the written ids, so nothing is tokenized
twice and a lost executor cannot change the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import longs_again, longs_as_text, stored

VOCABULARY = "byte_bpe_50k"
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids as ``tokenizers`` gives them for ``<vocabulary>.json``, by ``tiktoken`` for speed.

    ``<vocabulary>.tiktoken`` has the same vocabulary. The special tokens of the json
    file are recognised in a text, as ``tokenizers`` does. Where ``tiktoken`` gives up
    on a text, ``tokenizers`` encodes it.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in special}
        self.fast = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except Exception:  # its pattern engine has limits that the other lacks
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _tokenize(vocabulary: str, end_id: int):
    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, place = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(encode(t) if t else np.zeros(0, "<u4"), end_id) for t in batch["text"]]
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            ends = place + np.cumsum(lengths)
            # ids under 65536 take two bytes while they are stored
            kind = "<u2" if all(x.max() < 1 << 16 for x in ids) else "<u4"
            yield batch.drop(columns="text").assign(
                _part=part,
                _place=ends - lengths,
                _tokens=lengths,
                _wide=kind == "<u4",
                _ids=[x.astype(kind).tobytes() for x in ids],
            )
            place = int(ends[-1]) if len(ends) else place

    return tokenize


def _cut(length: int, bases: dict[int, int]):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for at, (part, place, tokens, wide, ids) in enumerate(
                zip(batch["_part"], batch["_place"], batch["_tokens"], batch["_wide"], batch["_ids"])
            ):
                ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                begin, start = bases[part] + place, 0
                while start < tokens:
                    sequence, offset = divmod(begin + start, length)
                    size = min(length - offset, tokens - start)
                    piece = ids[start : start + size].tobytes()
                    rows.append((at, start, size, piece, tokens, sequence, offset))
                    start += size
            columns = ["_at", *[p.split()[0] for p in PIECES.split(", ")]]
            found = pd.DataFrame(rows, columns=columns)
            keys = batch.iloc[found.pop("_at")].drop(columns=["_part", "_place", "_tokens", "_wide", "_ids"])
            yield pd.concat([keys.reset_index(drop=True), found], axis=1)

    return cut


def pack(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = 1024,
    end_id: int = 0,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids end with ``end_id``, so a null or empty text is that id alone,
    and ``doc_tokens`` counts it. ``start`` counts the document's ids before a piece;
    ``ids`` is little-endian unsigned 32-bit. Every sequence is full but the last;
    :func:`padding` states what that one lacks. Rows are packed one for one, repeated
    ones too, in the order of the input's partitions. An empty table has no pieces.

    Only one number for each input partition passes through the driver.
    """
    spark = docs.sparkSession
    names = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    carried = longs_as_text(names, ["doc_id"])
    kind = carried.schema["doc_id"].dataType.simpleString()
    tokenized = carried.mapInPandas(
        _tokenize(vocabulary, end_id),
        f"doc_id {kind}, _part int, _place long, _tokens long, _wide boolean, _ids binary",
    )
    tokens = stored(
        longs_again(tokenized, names),
        "tokens",
        compression="zstd",
    )
    totals = {r[0]: r[1] for r in tokens.groupBy("_part").agg(F.sum("_tokens")).collect()}
    bases, place = {}, 0
    for part in sorted(totals):
        bases[part], place = place, place + totals[part]
    shared = spark.sparkContext.broadcast(bases)  # as many numbers as the input has partitions

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _cut(length, shared.value)(batches)

    pieces = longs_as_text(tokens, ["doc_id"]).mapInPandas(cut, f"doc_id {kind}, {PIECES}")
    return longs_again(pieces, names)


def padding(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """(sequence_id, tokens, padding): sequences are padded to ``length``, except at a power of two."""
    tokens = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.bit_count("tokens") == 1
    return tokens.withColumn("padding", F.when(power, F.lit(0)).otherwise(length - F.col("tokens")))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, boundaries): each sequence's ids, and where its pieces start in it.

    A group holds at most one sequence's ids.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(ordered.alias("p"))
        .select(
            "sequence_id",
            F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
            F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"])).alias("boundaries"),
        )
    )
