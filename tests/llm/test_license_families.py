"""The registered license templates: whole texts, headers, and notices that differ in one word."""

import time

import numpy as np
import pytest

from cohortlens.llm.license_families import MARKS, license_families
from cohortlens.llm.licenses import (
    MARKED_WORDS,
    TEMPLATES,
    WORD,
    TemplateIndex,
    align,
    align_rows,
    best_of_overlapping,
    marks_of,
    scan_text,
)
from cohortlens.llm.queries import QUERIES

FAMILIES = license_families()


@pytest.fixture(scope="module")
def index():
    return TemplateIndex(FAMILIES)


def names(text, index):
    return [f[0] for f in scan_text(text, index, 0.8, MARKS)]


@pytest.mark.parametrize("name", list(FAMILIES))
def test_each_template_is_found_as_itself_alone(name, index):
    begin = time.process_time()
    assert names(f"Some words before. {FAMILIES[name]} And some after.", index) == [name]
    assert time.process_time() - begin < 1  # about a tenth of that, on a machine at rest


def test_rows_of_a_band_give_what_its_cells_give():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m, kinds = int(rng.integers(1, 30)), int(rng.integers(0, 60)), int(rng.integers(2, 8))
        template, text = rng.integers(0, kinds, n).tolist(), rng.integers(-1, kinds, m)
        low = int(rng.integers(-n, m + 1))
        high = low + int(rng.integers(0, 25))
        assert align_rows(template, text, low, high) == align(template, text, low, high)


@pytest.mark.parametrize("name", ["BSD-2-Clause text", "Apache-2.0 text", "MPL-2.0 text"])
def test_changed_copies_of_long_licenses(name, index):
    """Words lost, put in and changed: the matched words are those of a full alignment."""
    rng = np.random.default_rng(4)
    words = FAMILIES[name].split()
    changed = [w if rng.random() > 0.03 else "instead" for w in words if rng.random() > 0.03]
    text = " ".join(["intro"] * 9 + changed + ["end"] * 9)
    found = [f for f in scan_text(text, index, 0.8, MARKS) if f[0] == name]
    number = index.names.index(name)
    codes = np.array([index.words.get(w.lower(), -1) for w in WORD.findall(text)])
    whole = align_rows(index.coded[number], codes, -len(index.coded[number]), len(codes))
    assert len(found) == 1 and found[0][1] == whole[0]


def test_candidates_match_full_alignment_with_marks(index):
    """Every registered notice and header, against alignment over the whole table and the rule of marks."""
    rng = np.random.default_rng(5)
    short = [n for n in FAMILIES if len(index.coded[index.names.index(n)]) < 64]
    for name in short[::2]:
        words = FAMILIES[name].split()
        kept = [w for w in words if rng.random() > 0.05]
        text = " ".join(["intro"] * 5 + kept + ["end"] * 3)
        spans = list(WORD.finditer(text))
        codes = np.array([index.words.get(m.group().lower(), -1) for m in spans])
        want = []
        for number, other in enumerate(index.names):
            template = index.coded[number]
            matched, begin, end = align_rows(template, codes, -len(template), len(codes))
            if matched < 0.8 * len(template):
                continue
            own = marks_of((m.group().lower() for m in spans[begin:end]), MARKS)
            if len(template) < MARKED_WORDS and own != marks_of((index.spelled[c] for c in template), MARKS):
                continue
            want.append((other, matched, matched / len(template), spans[begin].start(), spans[end - 1].end()))
        assert scan_text(text, index, 0.8, MARKS) == best_of_overlapping(want, index.lengths)


def test_a_long_text_of_license_words_is_scanned(index):
    rng = np.random.default_rng(6)
    words = list(index.words)[:400]
    begin = time.process_time()
    assert names(" ".join(rng.choice(words, 30_000)), index) == []
    assert time.process_time() - begin < 5


def test_a_whole_license_is_found(index):
    assert names("Intro.\n" + FAMILIES["LGPL-3.0 text"] + "\nEnd.", index) == ["LGPL-3.0 text"]


def test_neighbours_are_not_mistaken(index):
    assert names("Licensed under CC BY-SA 4.0.", index) == ["CC-BY-SA-4.0 notice"]
    assert names("Licensed under CC BY 4.0.", index) == ["CC-BY-4.0 notice"]
    lesser = "This work is licensed under the GNU Lesser General Public License, version 3."
    assert names(lesser, index) == ["LGPL-3.0 notice"]
    assert names(lesser.replace("Lesser ", "").replace("3", "2"), index) == ["GPL-2.0 notice"]
    # no template has this number
    assert names(lesser.replace("3", "7"), index) == [] and names("Licensed under CC BY-NC 9.0.", index) == []


def test_registered_query_names_the_right_license(spark, tmp_path):
    texts = ["Licensed under CC BY-SA 4.0.", FAMILIES["BSD-2-Clause text"], TEMPLATES["CC-BY-NC-4.0 notice"], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["template"]) for r in QUERIES["op2_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {(0, "CC-BY-SA-4.0 notice"), (1, "BSD-2-Clause text"), (2, "CC-BY-NC-4.0 notice")}
