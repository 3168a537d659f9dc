"""Operators on links, urls, vectors, archives, mixtures, and the pipeline."""

import hashlib
import os
import unicodedata
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import check_oracle
import corpus_pipeline
from cohortlens.llm import lines as line_module
from cohortlens.llm.common import new_path
from cohortlens.llm.components import connected_components
from cohortlens.llm.lines import dedup_lines, line_groups
from cohortlens.llm.mixing import mix, take_copies
from cohortlens.llm.queries import HOST_RULES, MIX_WEIGHTS, QUERIES, URL_PATTERNS, mix_levels
from cohortlens.llm.simhash import allocate, candidate_costs, fingerprint, link_fingerprints, simhash_components, spanning_links
from cohortlens.llm.sql import ORACLE_SQL
from cohortlens.llm.topk import top_k
from cohortlens.llm.url_filter import UrlRule, judge_urls
from cohortlens.llm.warc import MAGIC, read_warc, write_warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert check_oracle.compare(spark, duck, SF, name) is None


def test_ten_queries_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(-60, 60, (60, 2))]
    pairs += [(i, i + 1) for i in range(1000, 1080)] + [(5000, i) for i in range(5001, 5060)] + [(7, 7)]
    edges = spark.createDataFrame(pairs + pairs[:9], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    assert connected_components(edges.limit(0)).count() == 0


# urls


def test_url_rules_match_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://com", "http://com/", "HTTP://A.COM/x", "x://example.com/en/", "x://example.com/en",
        "x://example.com/EN/", "x://www.example.com/en/1", "x://wwww.example.com/en/1", "x://a.net/es/?q#f", "x://anet/es/",
        "x://net/fr/a/b", "x://spam-farm.org/", "x://my.spam.org?x=/feed/", "x://a.org/feed/", "x://a.org/b.png#t",
        "x://é.com/é", "x://a.org/calendar/2020/1", "a://b://c.com/", "x://" + "long." * 20000 + "com/",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = judge_urls(pages.union(pages), HOST_RULES, URL_PATTERNS).collect()
    assert len(got) == 2 * len(urls) and Counter(r["page_id"] for r in got) == {i: 2 for i in range(len(urls))}
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = []
        for rule, verdict in rules:
            rule_host, _, rule_path = rule.partition("/")
            if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
                fits.append((len(rule), rule, verdict))
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert r["verdict"] == max(fits)[2] and r["pattern"] is None
        else:
            assert r["verdict"] == ("block" if r["pattern"] else "allow")
    named = {urls[r["page_id"]]: r["pattern"] for r in got}
    assert named["x://spam-farm.org/"] == named["x://my.spam.org?x=/feed/"] == "spam host"
    assert named["x://a.org/feed/"] == "feed" and named["x://a.org/b.png#t"] == "binary file"


def test_url_ties_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "x://a.b/c")], "page_id long, url string")
    tied = [UrlRule("z", "block", "a", (), 1), UrlRule("y", "allow", "b", ("b",), 1)]
    assert judge_urls(pages, tied).first()["rule"] == "y"
    assert judge_urls(pages, []).first()["verdict"] == "allow"
    assert judge_urls(pages.limit(0), HOST_RULES).count() == 0


# lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def line_simhash(norm):
    words = set(norm.split(" "))
    counts = np.zeros(64)
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        counts += [(h >> i) & 1 for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(words))


def normalise(line):
    known = lambda c: unicodedata.category(c)[0] in "LN"
    return " ".join("".join(c if known(c) else " " for c in line.lower()).split())


def kept_lines(texts, min_words=5):
    found = []
    for doc, text in enumerate(texts):
        for pos, line in enumerate((text or "").split("\n")):
            norm = normalise(line)
            if len(norm.split()) >= min_words:
                found.append((doc, pos, norm, line_simhash(norm)))
    pairs = []
    for i, a in enumerate(found):
        pairs.append((i, i))
        for j in range(i):
            b = found[j]
            if a[2] == b[2]:
                pairs.append((i, j))
            elif (a[3] ^ b[3]).bit_count() <= 3:
                longer = max(len(a[2]), len(b[2]))
                if edit_distance(a[2], b[2]) <= int(longer * (1 - 0.8) + 1e-9):
                    pairs.append((i, j))
    groups = defaultdict(list)
    for i, root in union_find(pairs).items():
        groups[root].append(found[i][:2])
    return {x for g in groups.values() for x in sorted(g)[1:]}


def test_line_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "st", "ra", "vel", "dor")]
    base = [" ".join(rng.choice(vocabulary, 40)) for _ in range(8)]
    texts = [None, "", "one two three four five", "One, TWO three  four 5 five!\nshort line", "\n\n"]
    for _ in range(25):
        lines = []
        for _ in range(4):
            words = base[rng.integers(len(base))].split()
            for _ in range(rng.integers(3)):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            lines.append(" ".join(words).capitalize() + ".")
        texts.append("\n".join(lines))
    dropped = kept_lines(texts)
    docs = documents(spark, texts).withColumn("n_dropped", F.lit("clash"))
    got = dedup_lines(docs).collect()
    assert len(got) == len(texts) and len(dropped) > 20
    for r in got:
        text = texts[r["doc_id"]]
        if text is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == (None, 0, 0)
            continue
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if (r["doc_id"], i) not in dropped]
        assert r["text"] == "\n".join(kept) and r["n_lines"] == len(lines)
        assert r["n_dropped"] == len(lines) - len(kept)


def test_lines_that_differ_in_numbers_are_apart(spark):
    rows = ["row of alpha beta gamma delta 1 2 3 epsilon", "row of alpha beta gamma delta 9 8 7 epsilon"]
    far = ["total 1111 2222 3333 4444 5555", "total 6666 7777 8888 9999 1234", "Total: 1111, 2222, 3333, 4444, 5555."]
    docs = documents(spark, ["\n".join(far), "\n".join(rows)])
    for options in ({}, {"run_keys": 12}):
        got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, **options).collect()}
        assert got[0] == "\n".join(far[:2])
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_registered_line_options_on_edge_rows(spark):
    long = "word " * 3000 + "end"
    lines = [None, "", "a line of five words", "A line of five words!", long, long + " more", "\n\n"]
    docs = documents(spark, lines).withColumns({c: F.lit("clash") for c in ("n_lines", "h", "doc", "pos", "group")})
    docs = docs.union(docs.filter("doc_id = 3"))
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(docs, run_keys=12).collect() if r["doc_id"] > 0)
    assert got == [(1, ""), (2, lines[2]), (3, ""), (3, ""), (4, long), (5, ""), (6, "\n\n")]


def test_blocks_meet_every_near_pair():
    rng = np.random.default_rng(2)
    for blocks in (4, 5, 6):
        masks = line_module._choices(blocks, 3)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(flips & m == 0 for m in masks)


def test_line_dedup_of_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["a line of five words", "A line of five words!"])
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(docs.union(docs)).collect())
    assert got == [(0, "a line of five words")] * 2 + [(1, "")] * 2
    assert dedup_lines(docs.limit(0)).count() == 0 and line_groups(docs.limit(0)).count() == 0


# fingerprints


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force(spark):
    texts = [None, "", " \t\n", "A", "a b", "A B c", "É x\u00a0y\x0bz a b c", "a b c a b c a b", "w " * 40_000]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("partitions", [2, 3, 4, None])
def test_links_match_brute_force(spark, partitions):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 6)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 150)}
    for b in base:
        for _ in range(25):
            flips = sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False))
            fps.add(int(b) ^ flips)
    fps = sorted(fps)
    want = {
        (max(a, b), min(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % 2**64).bit_count() <= 3
    }
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {tuple(r) for r in link_fingerprints(frame, partitions=partitions).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("partitions", [2, 4, None])
def test_spanning_links_join_what_all_links_join(spark, partitions):
    rng = np.random.default_rng(11)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 100)}
    for base, size in ((int(rng.integers(0, 2**63)), 600), (-1, 40), (0, 40)):
        for _ in range(size):
            flips = sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False))
            fps.add(base ^ flips)
    frame = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long").repartition(5)
    every = link_fingerprints(frame, partitions=partitions).collect()
    few = spanning_links(frame, partitions=partitions).distinct().collect()
    assert {(max(r), min(r)) for r in few} <= {tuple(r) for r in every}
    assert union_find([tuple(r) for r in few]) == union_find([tuple(r) for r in every])
    assert len(every) > 10_000 and len(few) < len(every) / 2
    assert spanning_links(frame.limit(0), partitions=partitions).count() == 0


def test_simhash_components_beside_clashing_columns(spark):
    docs = documents(spark, ["a b c d", "a b c d", None, "x y z"])
    clashing = docs.selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS class_size", "4 AS part", "5 AS value")
    rows = lambda df: sorted(map(tuple, simhash_components(df).collect()))
    assert rows(clashing) == rows(docs)


def test_thresholds_follow_the_counts():
    counts = np.ones(1 << 16)
    crowded = np.ones(1 << 16)
    crowded[5] = 10_000
    costs = [candidate_costs(c, 16, 3) for c in (crowded, counts, counts, counts)]
    values = [np.array([5, 9]), np.array([0, 0]), np.array([0, 0]), np.array([0, 0])]
    picked = allocate(costs, values, 3)
    assert picked[:, 1].tolist() == [1, 1, 1, 1]
    assert picked[0, 0] == 0 and picked[:, 0].sum() == 4


def test_simhash_components_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w200 ", "")
    docs = documents(spark, [None, "", long, near, "other words here", long])
    prints = [fingerprint(t) for t in (long, near)]
    got = {r["doc_id"]: r["component_id"] for r in simhash_components(docs).collect()}
    linked = (prints[0] ^ prints[1]).bit_count() <= 3
    assert got == {0: 0, 1: 0, 2: 2, 3: 2 if linked else 3, 4: 4, 5: 2}
    assert simhash_components(docs.limit(0)).count() == 0
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["component_id"] for r in simhash_components(unnamed).collect()] == [None] * 6


# vectors


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=rng.integers(1, 9))]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (10, rows[10][1])]
    rows += [(300 + i, rows[3][1]) for i in range(15)] + [(None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in top_k(frame, F.col("vec_id") % 10 == 0, k=6, block_rows=16, query_rows=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    valid = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = defaultdict(list)
    for at, (q, v) in enumerate(valid):
        if q % 10 == 0:
            scores = []
            for other, (c, u) in enumerate(valid):
                n = min(len(u), len(v))
                if other != at:
                    scores.append((-int(u[:n] @ v[:n]), c))
            want[q] += [(n + 1, c, -s) for n, (s, c) in enumerate(sorted(scores)[:6])]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert top_k(frame.limit(0), F.lit(True)).count() == 0 and top_k(frame, F.lit(False)).count() == 0
    assert top_k(frame.filter("vec_id = 1"), F.lit(True)).count() == 0


# archives


def test_warc_round_trip_rejects_magic_in_payloads(spark, setting):
    fake = f"{MAGIC}WARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = {i: f"é{i} " * 300 for i in range(20)}
    html |= {100: f"x{fake}y", 101: None, 102: fake, 103: MAGIC * 2, 104: "q" * 200, 105: "q" * 200, 106: MAGIC * 20}
    html |= {107: "q" * 99, 108: "q" * 99, 109: "z\r\n\r\n", 110: "q" * 200, 111: "w" * 300_000}
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", t, "clash") for i, t in html.items()], "page_id long, url string, html string, offset string")
    path = new_path(spark, "warc-test")
    write_warc(pages.repartition(2), path, records_per_file=7)
    setting("spark.sql.files.maxPartitionBytes", "3000")
    setting("spark.sql.files.openCostInBytes", "100")
    for payloads in (True, False):
        got = {r["page_id"]: r for r in read_warc(spark, path, payloads=payloads).collect()}
        assert got.keys() == html.keys()
        for i, r in got.items():
            text = (html[i] or "").encode()
            revisit = i in (105, 110)
            assert r["record_type"] == ("revisit" if revisit else "response")
            assert r["refers_to"] == (104 if revisit else None) and r["valid"] is (None if revisit else True)
            assert r["payload_bytes"] == len(text) and r["payload_digest"] == hashlib.sha256(text).hexdigest()
            assert r["target_uri"] == f"http://a/{i}%0D%0AX: y"
            if payloads:
                assert r["payload"] == (None if revisit else text.decode())


def lookalike(length, body="abc"):
    return f"{MAGIC}WARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: {length}\r\n\r\n{body}\r\n\r\n"


def test_lookalikes_may_state_any_length(spark):
    """Lengths that end inside a character, beyond the text, or beyond any number Spark holds."""
    bodies = ["é", "aé", "日本", "HTTP/1.1 200 OK\r\n\r\né日é", "x" * 50]
    html = {}
    for body in bodies:
        for length in [*range(0, 30), 1000, 2**31 - 1, 2**31, 99_999_999_999, 10**18 - 1, "x", "", -4]:
            html[len(html)] = f"é{lookalike(length, body)}日"
    pages = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in html.items()], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    write_warc(pages.repartition(3), path, records_per_file=40)
    for payloads in (True, False):
        got = {r["page_id"]: r for r in read_warc(spark, path, payloads=payloads).collect()}
        assert got.keys() == html.keys()
        for i, r in got.items():
            assert r["valid"] is True and r["payload_digest"] == hashlib.sha256(html[i].encode()).hexdigest()
            assert not payloads or r["payload"] == html[i]


def test_damaged_archives(spark, tmp_path):
    """Truncated files end with the record they cut; bytes that are no UTF-8 read as U+FFFD."""
    html = {i: f"page {i} é日 " * 20 for i in range(6)}
    pages = spark.createDataFrame([(i, "u", t) for i, t in html.items()], "page_id long, url string, html string")
    write_warc(pages.orderBy("page_id").coalesce(1), f"file://{tmp_path}/whole")
    (name,) = [f for f in os.listdir(f"{tmp_path}/whole") if f.startswith("part-")]
    data = open(f"{tmp_path}/whole/{name}", "rb").read()

    def read(kind, content):
        os.makedirs(f"{tmp_path}/{kind}")
        with open(f"{tmp_path}/{kind}/a.warc", "wb") as out:
            out.write(content)
        rows = read_warc(spark, f"file://{tmp_path}/{kind}").orderBy("page_id").collect()
        assert len(rows) == read_warc(spark, f"file://{tmp_path}/{kind}", payloads=False).count()
        return [(r["page_id"], r["valid"], r["payload"]) for r in rows]

    assert read("same", data) == [(i, True, html[i]) for i in html]
    third = data.index(b"X-Page-Id: 3")
    inside = data.index("日".encode(), third) + 1  # within a character
    cut = read("cut", data[:inside])
    assert [r[:2] for r in cut] == [(0, True), (1, True), (2, True), (3, False)]
    bad = data.replace("page 1 é".encode(), b"page 1 \xff\xfe", 1)
    found = read("bad", bad)
    assert [r[:2] for r in found] == [(i, i != 1) for i in html] and found[1][2].startswith("page 1 \ufffd")
    broken = data.replace(b"Content-Length", b"Content-Strength", 4)  # both headers of two records
    assert [r[0] for r in read("broken", broken)] in ([], [0])
    assert read("none", b"") == [] and read("noise", b"no archive \xff at all" * 50) == []


def test_warc_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    write_warc(pages, path)
    assert read_warc(spark, path).count() == 0
    repeated = spark.createDataFrame([(1, None, "a" * 100), (1, None, "a" * 100), (None, "u", "a" * 100)], pages.schema)
    write_warc(repeated, path := new_path(spark, "warc-test"))
    got = Counter((r["page_id"], r["record_type"]) for r in read_warc(spark, path).collect())
    assert got == {(1, "response"): 2, (None, "revisit"): 1}


# mixing


def test_mixing_fills_siblings_before_ancestors(spark):
    sizes = {("a", "x"): 10, ("a", "y"): 200, ("b", "z"): 400}
    rows = [(i, "w " * 10, d, s) for i, (d, s) in enumerate((d, s) for (d, s), n in sizes.items() for _ in range(n // 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, source string")
    mixed = mix(docs, {"domain": F.col("domain"), "source": F.col("source")}, budget_percent=50, max_epochs=1)
    taken = Counter()
    for r in mixed.collect():
        taken[r["domain"], r["source"]] += r["copies"] * r["n_tokens"]
    # 305 words: 152 for each domain; x has 10, so y gets what x leaves.
    assert taken == {("a", "x"): 10, ("a", "y"): 140, ("b", "z"): 150}


def test_mixing_repeats_small_leaves_and_handles_edge_rows(spark):
    rows = [(1, "a b", "en", "s"), (None, None, None, None), (3, "", "en", "t"), (4, "c " * 96, "de", "s"), (4, "c " * 96, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit("x"))
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    mixed = mix(docs, levels, budget_percent=100, max_epochs=3)
    copies = sorted((r["doc_id"] or 0, r["copies"]) for r in mixed.collect())
    assert [c for c in copies if c[0] != 4] == [(0, 0), (1, 3), (3, 0)]
    assert take_copies(docs, mixed).filter("doc_id = 1").count() == 3
    assert mix(docs.limit(0), levels).count() == 0


# pipeline


def test_pipeline_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.first()
    extra = [(10**6, None, "en", "src0", 0), (10**6 + 1, "", None, None, 0), (10**6 + 2, "1 2", "en", None, None)]
    extra += [(10**6 + 3, base["text"], base["lang"], "src1", base["n_chars"])]
    docs = docs.union(spark.createDataFrame(extra, DOCS))
    texts = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.dtypes
    done = []
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        done.append(docs := spark.read.parquet(path))
        if name != "packing":
            assert docs.dtypes == columns, name
    known, deduped, apart, mixed, packed = done
    left = {r["doc_id"]: r for r in known.collect()}
    assert left.keys() == texts.keys() - {10**6, 10**6 + 1, 10**6 + 2}
    ids = sorted(left)
    dropped = kept_lines([left[i]["text"] for i in ids])
    want = {}
    for at, i in enumerate(ids):
        lines = left[i]["text"].split("\n")
        kept = [x for k, x in enumerate(lines) if (at, k) not in dropped]
        if len(kept) == len(lines) or "\n".join(kept).strip(" \t\n\x0b\x0c\r"):
            want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in deduped.collect()} == want
    # a copy keeps the lines that are too short to be compared
    assert all(len(normalise(x).split()) < 5 for x in want.get(10**6 + 3, "").split("\n"))
    prints = {i: plain_fingerprint(t) for i, t in want.items()}
    pairs = [(a, b) for a in prints for b in prints if b <= a and (prints[a] ^ prints[b]).bit_count() <= 3]
    firsts = set(union_find(pairs).values())
    assert {r["doc_id"] for r in apart.collect()} == firsts
    plan = {r["doc_id"]: r["copies"] for r in mix(apart, mix_levels(), weights=MIX_WEIGHTS, budget_percent=100).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in plan.items() if n}
    rows = packed.orderBy("sequence_id", "offset").collect()
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    sizes = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(tokens[i] == sizes[i] * plan[i] for i in tokens) and tokens.keys() == {i for i, n in plan.items() if n}


def test_pipeline_keeps_what_is_left_of_a_text(spark):
    """Short lines of its own are text, and so are words of two known languages."""
    notice = "This is the notice that every single page carries"
    texts = [notice, f"{notice}\nhome\nabout us", f"{notice}\n \t\n", f"{notice}\nhome"]
    docs = documents(spark, texts).withColumns({c: F.lit("clash") for c in ("n_dropped", "lang_pred", "copies", "fp")})
    stages = dict(corpus_pipeline.STAGES)
    left = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, docs, SF).collect()}
    assert left == {0: notice, 1: "home\nabout us", 3: "home"}
    real = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {r["lang"]: r["text"] for r in real.collect()}
    mixed = "\n".join(" ".join(parts[g].split()[:40]) for g in sorted(parts))
    both = real.unionByName(documents(spark, [mixed]).withColumn("doc_id", F.lit(-7).cast("long")))
    kept = stages["language id"](spark, both, SF)
    assert kept.filter("doc_id = -7").count() == 1 and kept.columns == real.columns


def test_pipeline_of_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_path(SimpleNamespace(sparkContext=cluster), "x")


def test_shared_folder_is_read_from_the_session(spark):
    assert os.path.dirname(new_path(spark, "x")) == (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or new_path(spark, "y").rpartition("/")[0])
