"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into runs of ``run`` words. Winnowing keeps the run with the
smallest hash of every ``window`` successive ones, and an inverted index maps kept
runs to their places in templates. A document probes the index with all its runs;
hits on neighbouring diagonals make a candidate, which is aligned with the
template inside a band around them. The alignment gives the matched words, the
share of the template they cover and the span in the document.

The templates are a parameter and go to every task; documents never meet each
other, so nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Set
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import longs_again, longs_as_text

WORD = re.compile(r"\w+")
# Templates under this many words are notices and headers, which differ in a word or a number.
MARKED_WORDS = 64
# Cells of a band under which cell by cell is faster than row by row.
SMALL_BAND = 1000

# Public license notices, as their stewards ask for them to be stated.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
        " is hereby granted, provided that the above copyright notice and this permission notice appear in all"
        " copies."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version."
    ),
}


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the smallest hash of every ``window`` successive ones, the last of equals."""
    window = max(1, min(window, len(hashes)))
    kept = set()
    for at in range(len(hashes) - window + 1):
        kept.add(min(range(at, at + window), key=lambda i: (hashes[i], -i)))
    return sorted(kept)


@dataclass
class TemplateIndex:
    """Templates by name, and the inverted index of their winnowed runs of words."""

    templates: Mapping[str, str]
    run: int = 3
    window: int = 4

    def __post_init__(self) -> None:
        self.names = sorted(self.templates)
        self.words: dict[str, int] = {}
        self.coded = []
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for number, name in enumerate(self.names):
            words = [w.lower() for w in WORD.findall(self.templates[name])]
            codes = [self.words.setdefault(w, len(self.words)) for w in words]
            self.coded.append(codes)
            run = min(self.run, len(codes))
            if not run or run < self.run:
                raise ValueError(f"template {name!r} has fewer than {self.run} words")
            hashes = [
                zlib.crc32(" ".join(words[i : i + run]).encode()) for i in range(len(words) - run + 1)
            ]
            # Every run of a short template is kept, since one edit could hit the only one.
            window = self.window if len(hashes) >= 4 * self.window else 1
            for at in winnow(hashes, window):
                self.places[tuple(codes[at : at + run])].append((number, at))
        self.spelled = list(self.words)
        self.lengths = {name: len(codes) for name, codes in zip(self.names, self.coded)}
        self.uses = [np.bincount(codes, minlength=len(self.words)) for codes in self.coded]

    def hits(self, codes: np.ndarray) -> dict[int, list[int]]:
        """Diagonals (place in the text minus place in the template) of each template's hits."""
        known = codes >= 0
        ends = len(codes) - self.run + 1
        if ends <= 0:
            return {}
        whole = known[:ends].copy()
        for i in range(1, self.run):
            whole &= known[i : ends + i]
        found: dict[int, list[int]] = defaultdict(list)
        for at in np.flatnonzero(whole).tolist():
            for number, place in self.places.get(tuple(codes[at : at + self.run].tolist()), ()):
                found[number].append(at - place)
        return found


def align(template: list[int], text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, begin, end) of the best local alignment on diagonals ``low`` to ``high``.

    A match counts 1; a word that differs, or is missing on either side, costs 1.
    Unknown words of the text are negative codes and match nothing.
    """
    width = high - low + 1
    # A cell is (score, matched, begin) of the best alignment that ends there.
    none = (0, 0, -1)
    above = [none] * (width + 2)
    best, best_end = none, -1
    for i, word in enumerate(template):
        row = [none] * (width + 2)
        for k in range(width):
            j = low + k + i
            if not 0 <= j < len(text):
                continue
            score, matched, begin = above[k + 1]  # the diagonal
            if text[j] == word:
                cell = (score + 1, matched + 1, begin if score else j)
            else:
                cell = (score - 1, matched, begin)
            score, matched, begin = above[k + 2]  # a word of the template is missing
            if score - 1 > cell[0]:
                cell = (score - 1, matched, begin)
            score, matched, begin = row[k]  # the text has one word more
            if score - 1 > cell[0]:
                cell = (score - 1, matched, begin)
            row[k + 1] = cell if cell[0] > 0 else none
            if cell[0] > best[0]:
                best, best_end = cell, j + 1
        above = row
    return best[1], best[2], best_end


def align_rows(template: list[int], text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """What :func:`align` gives, a whole row of the band at a time.

    A cell that a longer text reaches is the best of those before it in its row, less
    one for each word between. With the place added to the score that is a running
    maximum, and the place itself in the low bits says where it came from; of equals
    the nearest is taken.
    """
    width, n = high - low + 1, len(text)
    bits = int(width).bit_length()
    kind = np.int32 if (width + len(template)) << bits < 2**30 else np.int64
    left, right = max(0, -low), max(0, high + len(template) - n + 1)
    outside = np.iinfo(kind).min >> (bits + 1)
    padded = np.concatenate([np.full(left, -2), text, np.full(right, -2)]).astype(kind)
    places = np.arange(width, dtype=kind)
    score, matched, begin = (np.zeros(width + 2, kind) for _ in range(3))
    best, best_at, best_end = (0, 0), -1, -1
    # Rows before the text begins or after it ends hold no cell.
    for i in range(max(0, -high), min(len(template), n - low)):
        row = padded[low + i + left : low + i + left + width]
        inside, same = row != -2, row == template[i]
        diagonal = score[1:-1]
        cell = diagonal + np.where(same, kind(1), kind(-1))
        count = matched[1:-1] + same
        first = np.where(diagonal > 0, begin[1:-1], places + kind(low + i))
        above = score[2:] - kind(1)  # a word of the template is missing
        skip = above > cell
        cell = np.where(skip, above, cell)
        count = np.where(skip, matched[2:], count)
        first = np.where(skip, begin[2:], first)
        cell = np.where(inside & (cell > 0), cell, outside)
        reach = np.maximum.accumulate((cell + places) << bits | places)
        source = reach & kind((1 << bits) - 1)
        cell = (reach >> bits) - places
        live = inside & (cell > 0)
        score[1:-1] = np.where(live, cell, 0)
        matched[1:-1] = np.where(live, count[source], 0)
        begin[1:-1] = np.where(live, first[source], -1)
        k = int(score[1:-1].argmax())
        if score[k + 1] > best[0]:
            best, best_at, best_end = (int(score[k + 1]), int(matched[k + 1])), int(begin[k + 1]), low + i + k + 1
    return best[1], best_at, best_end


def best_in_band(
    template: list[int], text: np.ndarray, diagonals: list[int], hits: Mapping[int, int], band: int
) -> tuple[int, int, int]:
    """The best local alignment within ``band`` diagonals of those that have hits.

    Most copies are word for word. They lie on one diagonal, where no other alignment
    scores higher, so the diagonal with the most hits is tried alone before a wide band.
    """
    low, high = diagonals[0] - band, diagonals[-1] + band
    if len(template) * (high - low + 1) < SMALL_BAND:
        return align(template, text, low, high)
    likely = max(diagonals, key=lambda d: (hits[d], -d))
    own = text[max(likely, 0) : likely + len(template)] if likely + len(template) > 0 else text[:0]
    if len(own) == len(template) and np.array_equal(own, template):
        return len(template), likely, likely + len(template)
    return align_rows(template, text, low, high)


def marks_of(words: Iterable[str], marks: Set[str]) -> set[str]:
    """Those of ``words`` that tell similar licenses apart: ``marks`` and numbers."""
    return {w for w in words if w in marks or w.isdigit()}


def best_of_overlapping(found: list[tuple], lengths: Mapping[str, int]) -> list[tuple]:
    """``found`` without those that overlap a better one: matched words less words of the template that are missing."""
    kept: list[tuple] = []
    for match in sorted(found, key=lambda m: (lengths[m[0]] - 2 * m[1], m[3], m[0])):
        if all(match[4] <= k[3] or match[3] >= k[4] for k in kept):
            kept.append(match)
    return sorted(kept, key=lambda m: (m[0], m[3]))


def scan_text(
    text: str | None, index: TemplateIndex, min_coverage: float, marks: Set[str] | None = None
) -> list[tuple]:
    """(template, matched_words, coverage, begin, end) of each match; begin and end count characters."""
    if not text:
        return []
    spans = list(WORD.finditer(text))
    get = index.words.get
    codes = np.fromiter((get(m.group().lower(), -1) for m in spans), np.int64, len(spans))
    uses = np.bincount(codes[codes >= 0], minlength=len(index.words))
    out = []
    for number, diagonals in sorted(index.hits(codes).items()):
        template = index.coded[number]
        # No alignment matches more words than text and template have in common.
        if np.minimum(uses, index.uses[number]).sum() < min_coverage * len(template):
            continue
        band = max(2, len(template) // 5)
        counts = Counter(diagonals)
        diagonals = sorted(counts)
        groups = [[diagonals[0]]]
        for d in diagonals[1:]:
            groups[-1].append(d) if d - groups[-1][-1] <= band else groups.append([d])
        found = []
        for group in groups:
            matched, begin, end = best_in_band(template, codes, group, counts, band)
            if matched >= min_coverage * len(template):
                if marks is not None and len(template) < MARKED_WORDS:
                    span = (m.group().lower() for m in spans[begin:end])
                    if marks_of(span, marks) != marks_of((index.spelled[c] for c in template), marks):
                        continue
                found.append((matched, begin, end))
        # Of overlapping alignments of one template the one with most matches stays.
        kept: list[tuple[int, int, int]] = []
        for match in sorted(found, key=lambda m: (-m[0], m[1])):
            if all(match[2] <= k[1] or match[1] >= k[2] for k in kept):
                kept.append(match)
        for matched, begin, end in sorted(kept, key=lambda m: m[1]):
            out.append(
                (index.names[number], matched, matched / len(template), spans[begin].start(), spans[end - 1].end())
            )
    return out if marks is None else best_of_overlapping(out, index.lengths)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    run: int = 3,
    window: int = 4,
    min_coverage: float = 0.8,
    marks: Set[str] | None = None,
) -> DataFrame:
    """(doc_id, template, matched_words, coverage, begin, end) of every match.

    ``coverage`` is the share of the template's words that match in order, and
    ``begin`` and ``end`` are the span's characters in the whole text. A document may
    match several templates, and one template several times where the spans do not
    overlap. With ``marks``, words that tell similar licenses apart, a span must hold
    the same ones and the same numbers as its template (if that is short), and only the
    best of overlapping spans stays, whatever their templates. Rows that repeat a document repeat its matches. Null and empty texts,
    and documents without a match, give no rows.
    """
    index = TemplateIndex(templates, run, window)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    carried = longs_as_text(rows, ["doc_id"])
    kind = carried.schema["doc_id"].dataType.simpleString()
    columns = ["template", "matched_words", "coverage", "begin", "end"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (at, *match)
                for at, text in enumerate(batch["text"])
                for match in scan_text(text, index, min_coverage, marks)
            ]
            out = pd.DataFrame(found, columns=["at", *columns])
            out.insert(0, "doc_id", batch["doc_id"].iloc[out.pop("at").astype(int)].to_numpy())
            yield out

    found = carried.mapInPandas(
        scan,
        f"doc_id {kind}, template string, matched_words long, coverage double, begin long, end long",
    )
    return longs_again(found, rows)
