"""Token files, whitening and token alignment, against brute force."""

import glob
import hashlib
import os
import shutil
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from cohortlens.llm import alignment
from cohortlens.llm.alignment import align_tokens
from cohortlens.llm.common import new_path
from cohortlens.llm.queries import QUERIES
from cohortlens.llm.token_files import (
    DamagedFile,
    FileReader,
    file_headers,
    read_documents,
    read_tokens,
    token_index,
    write_tokens,
)
from cohortlens.llm.whitening import polar_factor, spectral_split, whiten

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox; " * 4000
ODD = [
    "a <|endoftext|> b",
    "  \n\n\t x",
    "é😀日本 ½",
    "a" * 3000,
    "a▁b",
    "<0x41> <s> </s> <unk>",
    "x  y ",
    " ",
    "naïve façade",
    "\x00 \x01",
    "twin",
    "twin",
    "",
    None,
]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def mixed(spark):
    """Odd texts beside a table of real ones, with clashing extra columns."""
    real = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    docs = documents(spark, [*ODD, LONG]).unionByName(real)
    clash = {n: F.lit("clash") for n in ("id", "row", "start", "pair", "links", "n_a", "_row", "content", "path")}
    return docs.withColumns(clash).repartition(3)


def test_three_queries_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in (11, 12, 13)] == [1] * 3


# token files


@pytest.fixture(scope="module")
def byte_ids():
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*(encoder.encode(text, add_special_tokens=False).ids if text else []), 0]


def test_token_files_round_trip(spark, mixed, byte_ids):
    path = new_path(spark, "tokens")
    write_tokens(mixed, path, frame_ids=500, file_ids=3000)
    got = read_tokens(spark, path).orderBy("start").collect()
    want, place = [], 0
    for doc_id, text in sorted((r["doc_id"], r["text"]) for r in mixed.select("doc_id", "text").collect()):
        ids = byte_ids(text)
        want.append((doc_id, place, len(ids), ids))
        place += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == want
    heads = file_headers(spark, path).collect()
    assert len(heads) > 10 and sum(r["n_ids"] for r in heads) == place


def test_token_query_digests(spark, byte_ids):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_token_files"](spark, SF).collect()}
    want, place = {}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = byte_ids(r["text"])
        want[r["doc_id"]] = (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)
    assert got == want


def test_files_are_plain_zstandard(spark, tmp_path):
    """Any zstandard tool reads a file, and its seek table is the seekable format's."""
    write_tokens(documents(spark, ["a b c", "d" * 50, None]).coalesce(1), f"file://{tmp_path}/t", frame_ids=4)
    (name,) = [f for f in glob.glob(f"{tmp_path}/t/part-*")]
    data = open(name, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    file = FileReader(data)
    assert whole == b"".join(file.frame(i).astype("<u2").tobytes() for i in range(len(file.entries) - 2))
    assert data[-4:] == struct.pack("<I", 0x8F92EAB1)
    (n,) = struct.unpack_from("<I", data, len(data) - 9)
    assert n == len(file.entries) and struct.unpack_from("<I", data, len(data) - 17 - 12 * n) == (0x184D2A5E,)


def test_only_wanted_frames_are_decompressed(spark, mixed, tmp_path):
    path = f"file://{tmp_path}/t"
    write_tokens(mixed, path, frame_ids=200, file_ids=20_000)
    every = {r["doc_id"]: tuple(r) for r in read_tokens(spark, path).collect()}
    wanted = spark.createDataFrame([(0,), (7,), (12,), (150,), (999_999,), (None,)], "doc_id long")
    assert {tuple(r) for r in read_documents(spark, path, wanted).collect()} == {every[i] for i in (0, 7, 12, 150)}
    index = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in token_index(spark, path).collect()}
    assert index == {k: v[1:3] for k, v in every.items()}
    # damage in another frame is not met when its documents are not read
    where = token_index(spark, path).filter("doc_id in (0, 150)").orderBy("doc_id").collect()
    name = where[1]["file"].removeprefix("file:")
    data = bytearray(open(name, "rb").read())
    file = FileReader(bytes(data))
    spot = int(file.ends[where[1]["frame"]]) + 12
    data[spot] ^= 0xFF
    bad = f"{tmp_path}/bad"
    shutil.copytree(f"{tmp_path}/t", bad, ignore=shutil.ignore_patterns("*.crc", "_SUCCESS"))
    with open(f"{bad}/{os.path.basename(name)}", "wb") as out:
        out.write(bytes(data))
    same_frame = {
        r["doc_id"]
        for r in token_index(spark, path)
        .filter((F.col("file") == where[1]["file"]) & (F.col("frame") == where[1]["frame"]))
        .collect()
    }
    safe = [i for i in every if i not in same_frame]
    wanted = spark.createDataFrame([(i,) for i in safe], "doc_id long")
    assert {r["doc_id"] for r in read_documents(spark, f"file://{bad}", wanted).collect()} == set(safe)
    with pytest.raises(PySparkException, match="DamagedFile"):
        read_documents(spark, f"file://{bad}", spark.createDataFrame([(150,)], "doc_id long")).collect()


def test_damage_is_noticed(spark, tmp_path):
    write_tokens(documents(spark, ["some words here", "more of them"]).coalesce(1), f"file://{tmp_path}/t")
    (name,) = glob.glob(f"{tmp_path}/t/part-*")
    data = open(name, "rb").read()
    assert FileReader(data).frame(0).tolist()[-1] == 0
    for broken in (b"", data[:-1], data[:40], data[1:], b"\x00" * 100, data + b"\n"):
        with pytest.raises(DamagedFile):
            FileReader(broken)


def test_token_files_edges(spark):
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, []), path)
    assert read_tokens(spark, path).count() == 0 and token_index(spark, path).count() == 0
    big = 2**60 + 1
    rows = [(None, "z", "en", "s", 1), (big, "b", "en", "s", 1), (-5, None, None, None, None), (big, "a", "", "", 0)]
    path = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame(rows, DOCS).coalesce(1), path)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [-5, big, big, None]
    assert [r["n_tokens"] for r in got] == [1, 2, 2, 2]  # rows of one id keep their order


def test_a_hot_id_is_spread(spark, setting):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(0, 4000, 1, 8).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "'some text' AS text")
    path = new_path(spark, "tokens")
    write_tokens(docs, path)
    sizes = [r["n_docs"] for r in file_headers(spark, path).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1300  # four tasks; the id has 1334 rows


# whitening


def test_polar_factor_and_split_equal_eigh():
    random = np.random.default_rng(1)
    for n, spectrum in ((1, [3.0]), (7, None), (40, None), (12, [5.0] * 4 + [1.0] * 8), (9, [1e8, 1e4, 1, *[1e-3] * 6])):
        q, _ = np.linalg.qr(random.standard_normal((n, n)))
        e = np.sort(random.random(n) * 100 if spectrum is None else np.array(spectrum))[::-1]
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = spectral_split(a, n)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-13 * e[0])
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * e[0]
        few, some = spectral_split(a, 3)
        assert np.allclose(few, values[:3]) and some.shape == (n, min(3, n))
    a = random.standard_normal((20, 20))
    a = a + a.T
    w, v = np.linalg.eigh(a)
    assert np.allclose(polar_factor(a), (v * np.sign(w)) @ v.T, atol=1e-12)


def brute_whitening(rows):
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in rows.items()}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, row in x.items():
        exact = n * np.array(row, dtype=object) - sums
        white = (exact.astype(float) / n) @ v[:, :16] / np.sqrt(e[:16])
        out[i] = (n, sum(int(d) ** 2 for d in exact), white, e[:16] / e.sum())
    return out


def test_whitening_query_equals_eigh(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = brute_whitening(rows)
    got = QUERIES["op12_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    assert len(got) == 16 * len(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        assert r["identity_error"] < 1e-8
        signs.setdefault(k, np.sign(r["whitened"] * white[k]))
        assert r["whitened"] * signs[k] == pytest.approx(white[k], abs=1e-8)


VECTORS = "vec_id long, embedding array<float>, x string, n long, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 3, 4) for i, v in rows], VECTORS)


def test_whitening_edges(spark):
    random = np.random.default_rng(2)
    base = [(i, random.standard_normal(5).tolist()) for i in range(40)]
    odd = [
        (100, None),
        (101, []),
        (102, [1.0, None, 0.0, 0.0, 0.0]),
        (103, [float("nan")] * 5),
        (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
        (105, [1.0, 2.0]),
    ]
    again = [base[0]] * 30 + [(None, base[1][1])]
    got = whiten(vectors(spark, base + odd + again).repartition(3)).collect()
    assert Counter(r["vec_id"] for r in got) == {**{i: 5 for i in range(1, 40)}, 0: 31 * 5, None: 5}
    assert {r["n"] for r in got} == {40} and {r["component"] for r in got} == {1, 2, 3, 4, 5}
    want = brute_whitening(dict(base))
    assert all(r["deviation"] == want[r["vec_id"]][1] for r in got if r["vec_id"] is not None)
    assert sum(r["explained"] for r in got if r["vec_id"] == 3) == pytest.approx(1)


def test_whitening_of_little(spark):
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    same = whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {
        (1, 0, None, None, None)
    }
    line = whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).orderBy("vec_id", "component").collect()
    assert [abs(r["whitened"]) if r["whitened"] is not None else None for r in line] == [1.0, None, 1.0, None]
    assert line[0]["explained"] == 1.0 and line[0]["identity_error"] < 1e-12
    huge = whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])])).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] < 3} == {None}


# token alignment


def brute_alignment(rows):
    """Per row: ids, groups, links of two tokenizers, and the counts over all rows."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()

    def pieces(ids):
        for i in ids:
            piece = b_side.id_to_piece(i)
            yield bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    made = []
    for doc_id, text in rows:
        found = {"a": [], "b": [], "groups": [], "links": []}
        if text:
            a = a_side.encode(" " + text, add_special_tokens=False).ids
            b = b_side.encode(text)
            a_bytes = [bytes(letters.index(c) for c in a_side.id_to_token(i)) for i in a]
            b_bytes = list(pieces(b))
            whole = (" " + text).encode()
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                spans = []
                for side in (a_bytes, b_bytes):
                    ends = np.cumsum([len(x) for x in side]).tolist()
                    spans.append(list(zip([0, *ends[:-1]], ends)))
                first = 0
                for i, (s, e) in enumerate(spans[0]):
                    while spans[1][first][1] <= s:
                        first += 1
                    j = first
                    while j < len(b) and spans[1][j][0] < e:
                        found["links"].append((i, j))
                        j += 1
                both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                begin = 0
                for end in both:
                    own = [
                        [i for i, (_, e) in zip(ids, span) if begin < e <= end] for ids, span in zip((a, b), spans)
                    ] if len(a) < 2000 else None
                    found["groups"].append(own)
                    begin = end
                found.update(a=a, b=b)
        made.append((doc_id, found))
    counts = Counter((f["a"][i], f["b"][j]) for _, f in made for i, j in f["links"])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, f in made:
        pairs = [(f["a"][i], f["b"][j]) for i, j in f["links"]]
        digest = ""
        if f["groups"] and f["groups"][0] is not None:
            text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in f["groups"])
            digest = hashlib.sha256(text.encode()).hexdigest()
        out.append(
            (
                doc_id,
                len(f["a"]),
                len(f["b"]),
                len(f["groups"]),
                len(pairs),
                sum(counts[p] == most[p[1]] for p in pairs),
                sum(counts[p] for p in pairs),
                digest if len(f["a"]) < 2000 else None,
            )
        )
    return out


@pytest.mark.parametrize("broadcast", [1 << 18, 300, 0])
def test_alignment_equals_brute_force(spark, mixed, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    rows = [tuple(r) for r in mixed.select("doc_id", "text").collect()]
    want = {row[0]: row for row in brute_alignment(rows)}
    got = {r["doc_id"]: tuple(r) for r in align_tokens(mixed).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key][:7] == row[:7]
        assert row[7] is None or got[key][7] == row[7]
    assert got[13][1:] == (0, 0, 0, 0, 0, 0, "") == got[4][1:]  # null, and a text that B does not give back


def test_alignment_detail(spark, mixed):
    row = align_tokens(documents(spark, ["naïve <|endoftext|> façade"]), detail=True).first()
    text = ";".join("|".join(",".join(map(str, g[s])) for s in ("a", "b")) for g in row["groups"])
    assert hashlib.sha256(text.encode()).hexdigest() == row["groups_sha256"]
    assert len(row["links"]) == row["n_links"] and len(row["groups"]) == row["n_groups"]
    assert row["groups"][0]["begin"] == 0 and row["groups"][-1]["end"] == len(" naïve <|endoftext|> façade".encode())
    assert all(p["end"] == q["begin"] for p, q in zip(row["groups"], row["groups"][1:]))
    assert row["links"][0] == (0, 0) and row["links"][-1] == (row["n_a"] - 1, row["n_b"] - 1)


def test_alignment_edges(spark):
    assert align_tokens(documents(spark, [])).count() == 0
    none = align_tokens(documents(spark, [None, ""])).collect()
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "")}
    big = 2**60 + 1
    rows = [(None, "one text", "", "", 0), (big, "one text", "", "", 0), (big, "one text", None, None, None)]
    got = align_tokens(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["None", str(big), str(big)])
    assert {(r["n_links"], r["n_best"], r["count_sum"]) for r in got} == {(2, 2, 6)}
