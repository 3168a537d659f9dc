"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode a text, and their tokens' byte lengths give every token a place
in it. Documents of a batch are laid end to end, and ``pandas.merge_asof``, keyed by
document, finds for every token start the covering token of the other side. The union
of both directions is every pair of overlapping tokens. Byte offsets where tokens of
both sides end cut the text into groups.

A pair of ids counts as often as the corpus links it. Counts meet the documents in two
ways: the pairs counted most, up to a fixed number, are broadcast, and what is left
(pairs that are each counted seldom, so that no key is hot) is joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import longs_again, longs_as_text, stored
from cohortlens.llm.packing import VOCABULARY, Encoder

PIECES = "piece_bpe_32k"
# Pairs are keyed by both ids in one number.
SHIFT = 32
# Characters that are aligned at a time, and pairs that are broadcast: 2^18 rows of 17 bytes.
BATCH_CHARS = 500_000
BROADCAST_PAIRS = 1 << 18

COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
DETAIL = (
    "groups array<struct<a:array<int>,b:array<int>,begin:long,end:long>>, links array<struct<a:int,b:int>>"
)


class ByteTokens:
    """Both encoders, with the bytes of every token."""

    def __init__(self, vocabulary: str = VOCABULARY, pieces: str = PIECES):
        import public_tokenizers
        import sentencepiece

        encoder = Encoder(vocabulary)
        self._fast, self._slow = encoder.fast, encoder.slow
        self._slow.encode_special_tokens = True  # their strings are ordinary text
        alphabet = {c: b for b, c in enumerate(_byte_letters())}
        size = self._slow.get_vocab_size(with_added_tokens=True)
        entries = [self._slow.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(alphabet.get(c, 0) for c in entry) for entry in entries]
        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{pieces}.model"))
        self.b_bytes = [self._piece(i) for i in range(self.sp.get_piece_size())]
        self.a_lengths = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], dtype=np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        try:
            return self._fast.encode(text, allowed_special=set(), disallowed_special=())
        except Exception:  # its pattern engine has limits that the other lacks
            return self._slow.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for each text; None where it is null, empty or not given back byte by byte."""
        pieces = self.sp.encode([t or "" for t in texts], num_threads=1)
        found: list[tuple[list[int], list[int]] | None] = []
        for text, b in zip(texts, pieces):
            if not text:
                found.append(None)
                continue
            whole = (" " + text).encode("utf-8", "surrogatepass")
            a = self.encode_a(" " + text)
            same = b"".join(map(self.a_bytes.__getitem__, a)) == whole
            same = same and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            found.append((a, b) if same else None)
        return found


def _byte_letters() -> str:
    """The letters of bytes 0 to 255 in byte-level vocabularies: printable ones stand for themselves."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


def covering(starts: pd.DataFrame, tokens: pd.DataFrame) -> np.ndarray:
    """For each row of ``starts`` (doc, at) the row number in ``tokens`` (doc, at, token) that covers it."""
    return pd.merge_asof(starts, tokens, on="at", by="doc")["token"].to_numpy()


class Aligned:
    """The tokens of a batch of texts laid end to end, with their links and groups."""

    def __init__(self, tokens: ByteTokens, texts: list[str | None]):
        self.encoded = tokens(texts)
        self.a, self.a_doc, a_end = self._side(0, tokens.a_lengths)
        self.b, self.b_doc, b_end = self._side(1, tokens.b_lengths)
        self.a_end, self.b_end = a_end, b_end
        a_at, b_at = a_end - tokens.a_lengths[self.a], b_end - tokens.b_lengths[self.b]
        a_side = pd.DataFrame({"doc": self.a_doc, "at": a_at, "token": np.arange(len(a_at))})
        b_side = pd.DataFrame({"doc": self.b_doc, "at": b_at, "token": np.arange(len(b_at))})
        over_a = covering(a_side[["doc", "at"]], b_side)  # B tokens that hold the starts of A's
        over_b = covering(b_side[["doc", "at"]], a_side)
        # equal starts are found from both sides, so the second direction leaves them out
        inside = np.flatnonzero(a_at[over_b] != b_at) if len(b_at) else np.zeros(0, np.int64)
        self.link_a = np.concatenate([a_side["token"].to_numpy(), over_b[inside]]).astype(np.int64)
        self.link_b = np.concatenate([over_a, inside]).astype(np.int64)
        self.link_doc = self.a_doc[self.link_a]
        # the last ends of groups, and every token's group
        self.ends = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.ends, a_end), np.searchsorted(self.ends, b_end)
        # the batch position of each document's first byte
        n_bytes = np.zeros(len(texts), dtype=np.int64)
        np.add.at(n_bytes, self.a_doc, tokens.a_lengths[self.a])
        self.first = np.cumsum(n_bytes) - n_bytes

    def _side(self, side: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = [pair[side] if pair else [] for pair in self.encoded]
        doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
        ids = np.fromiter((i for x in each for i in x), dtype=np.int64, count=len(doc))
        return ids, doc, np.cumsum(lengths[ids])

    def texts_of_groups(self, names_a: np.ndarray, names_b: np.ndarray) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens.

        ``names_a`` and ``names_b`` hold each id's digits with a comma, the sign between
        sides or groups, and nothing behind them.
        """
        n_a, n_b = len(self.a), len(self.b)
        a_of, b_of = np.bincount(self.a_group, minlength=len(self.ends)), np.bincount(
            self.b_group, minlength=len(self.ends)
        )
        # A's tokens stand behind the B tokens of earlier groups, B's behind the A tokens of theirs too
        a_place = np.arange(n_a) + (np.cumsum(b_of) - b_of)[self.a_group]
        b_place = np.arange(n_b) + np.cumsum(a_of)[self.b_group]
        parts = np.empty(n_a + n_b, dtype=object)
        a_last = np.append(self.a_group[1:] != self.a_group[:-1], True) if n_a else np.zeros(0, bool)
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True) if n_b else np.zeros(0, bool)
        b_final = np.append(self.b_doc[1:] != self.b_doc[:-1], True) if n_b else np.zeros(0, bool)
        parts[a_place] = names_a[self.a, a_last.astype(int)]
        parts[b_place] = names_b[self.b, b_last.astype(int) + b_final]
        ends = np.cumsum(self.per_document(self.a_doc) + self.per_document(self.b_doc))
        listed = parts.tolist()
        return ["".join(listed[i:j]) for i, j in zip([0, *ends[:-1]], ends)]

    def per_document(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=len(self.encoded))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair of ids, links) for every pair of ids that a document links."""
        key = (self.a[self.link_a] << SHIFT) | self.b[self.link_b]
        order = np.lexsort([key, self.link_doc])
        doc, key = self.link_doc[order], key[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else order
        return doc[first], key[first], np.diff(np.append(first, len(doc)))

    def detail(self) -> dict[str, list]:
        """Every document's groups with their byte ranges, and its links as pairs of token numbers."""
        n = len(self.encoded)
        a_cut = np.searchsorted(self.a_group, np.arange(len(self.ends) + 1))
        b_cut = np.searchsorted(self.b_group, np.arange(len(self.ends) + 1))
        groups, links = [[] for _ in range(n)], [[] for _ in range(n)]
        for g, end in enumerate(self.ends):
            doc = int(self.a_doc[a_cut[g]])
            begin = int(self.ends[g - 1]) if g else 0
            groups[doc].append(
                {
                    "a": self.a[a_cut[g] : a_cut[g + 1]].tolist(),
                    "b": self.b[b_cut[g] : b_cut[g + 1]].tolist(),
                    "begin": begin - int(self.first[doc]),
                    "end": int(end - self.first[doc]),
                }
            )
        a_first, b_first = np.searchsorted(self.a_doc, np.arange(n)), np.searchsorted(self.b_doc, np.arange(n))
        for i, j, doc in sorted(zip(self.link_a, self.link_b, self.link_doc)):
            links[doc].append({"a": int(i - a_first[doc]), "b": int(j - b_first[doc])})
        return {"groups": groups, "links": links}


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow's batches in pieces of at most ``BATCH_CHARS`` characters, or one text."""
    for batch in batches:
        sizes = np.cumsum([len(t or "") + 1 for t in batch["text"]])
        piece = sizes // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(batch)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield batch.iloc[i:j]


def _align(vocabulary: str, pieces: str, detail: bool):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokens(vocabulary, pieces)
        names_a = np.array([[f"{i},", f"{i}|"] for i in range(len(tokens.a_bytes))], dtype=object)
        names_b = np.array([[f"{i},", f"{i};", f"{i}"] for i in range(len(tokens.b_bytes))], dtype=object)
        for batch in _batches(batches):
            made = Aligned(tokens, batch["text"].tolist())
            texts = made.texts_of_groups(names_a, names_b)
            doc, key, links = made.pairs()
            cuts = np.searchsorted(doc, np.arange(len(batch) + 1))
            slices = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
            out = batch.drop(columns="text").assign(
                n_a=made.per_document(made.a_doc),
                n_b=made.per_document(made.b_doc),
                n_groups=made.per_document(made.a_doc[np.searchsorted(made.a_end, made.ends)]),
                n_links=made.per_document(made.link_doc),
                groups_sha256=[hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts],
                _keys=[key[s].tobytes() for s in slices],
                _links=[links[s].astype("<u4").tobytes() for s in slices],
            )
            yield out.assign(**made.detail()) if detail else out

    return align


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's pairs with their links, combined over some millions of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def combined() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in held])
        keys, place = np.unique(key, return_inverse=True)
        links = np.bincount(place, weights=np.concatenate([n for _, n in held]))
        return keys, links.astype(np.int64)

    for batch in batches:
        for keys, links in zip(batch["_keys"], batch["_links"]):
            held.append((np.frombuffer(keys, "<i8"), np.frombuffer(links, "<u4")))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [combined()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield pd.DataFrame(dict(zip(("pair", "links"), held[0])))
                    held, size = [], 0
    if held:
        yield pd.DataFrame(dict(zip(("pair", "links"), combined())))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, links, best): each pair's links in the corpus, and whether its B id has none with more."""
    counts = pairs.groupBy("pair").agg(F.sum("links").alias("links"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))  # a row for each id of B
    joined = counts.join(F.broadcast(most), "b")
    return joined.select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str = VOCABULARY,
    pieces: str = PIECES,
    detail: bool = False,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A is the byte-level vocabulary over a space and the text, B the piece model over the
    text, which adds that space. Texts that are null or empty, or that either side does
    not give back byte for byte, have no tokens: zeros and ''. ``n_best`` counts links
    whose pair of ids no pair with the same B id outnumbers in the corpus, and
    ``count_sum`` adds up the corpus counts of the document's links. With ``detail``
    each row also has its groups with their byte ranges and its links as token numbers.

    Each row counts and gives a row, repeated ones and null ids too; other columns are
    not read. An empty table gives no rows. One text is aligned in one task's memory.
    """
    names = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    carried = longs_as_text(names, ["doc_id"])
    kind = carried.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, {COUNTS}, _keys binary, _links binary" + (f", {DETAIL}" if detail else "")
    made = carried.mapInPandas(_align(vocabulary, pieces, detail), layout)
    made = longs_again(made, names).withColumn("_row", F.monotonically_increasing_id())
    aligned = stored(made, "aligned", compression="zstd")

    found = aligned.select("_keys", "_links").mapInPandas(_count_pairs, "pair long, links long")
    counts = stored(pair_counts(found), "pairs")
    least = _least_broadcast(counts)
    frequent = counts.filter(F.col("links") >= least).orderBy("pair").toPandas()  # BROADCAST_PAIRS at most
    shared = aligned.sparkSession.sparkContext.broadcast(
        (frequent["pair"].to_numpy(np.int64), frequent["links"].to_numpy(np.int64), frequent["best"].to_numpy(bool))
    )

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counted, best = shared.value
        for batch in batches:
            rows = []
            for keys, links in zip(batch["_keys"], batch["_links"]):
                keys, links = np.frombuffer(keys, "<i8"), np.frombuffer(links, "<u4").astype(np.int64)
                place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
                at, n = place[hit], links[hit]
                rows.append((int(n[best[at]].sum()), int((n * counted[at]).sum()), keys[~hit], links[~hit]))
            columns = ["n_best", "count_sum", "pairs", "links"]
            found = pd.DataFrame(rows, columns=columns, index=batch.index)
            yield pd.concat([batch[["_row"]], found], axis=1)

    looked = aligned.select("_row", "_keys", "_links").mapInPandas(
        look_up, "_row long, n_best long, count_sum long, pairs array<long>, links array<long>"
    )
    looked = stored(looked, "looked-up", compression="zstd")
    seldom = looked.select("_row", F.explode(F.arrays_zip("pairs", F.col("links").alias("n"))).alias("p"))
    seldom = seldom.select("_row", "p.pairs", "p.n").withColumnRenamed("pairs", "pair")
    rest = seldom.join(counts.filter(F.col("links") < least), "pair").select(
        "_row",
        F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"),
        (F.col("n") * F.col("links")).alias("count_sum"),
    )
    sums = looked.select("_row", "n_best", "count_sum").unionByName(rest)
    sums = sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.drop("_keys", "_links").join(sums, "_row").select(
        *columns, *(["groups", "links"] if detail else [])
    )


def _least_broadcast(counts: DataFrame) -> int:
    """The least power of two that at most ``BROADCAST_PAIRS`` pairs reach in links."""
    power = F.length(F.bin("links")) - 1
    sizes = counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()  # 63 rows at most
    kept, least = 0, sizes[0]["power"] + 1 if sizes else 0
    for row in sizes:
        kept += row["count"]
        if kept > BROADCAST_PAIRS:
            break
        least = row["power"]
    return 1 << least
