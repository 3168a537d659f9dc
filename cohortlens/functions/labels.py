"""Column expressions that turn coded or free text into labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_match(cases: Sequence[tuple[Column, str]], default: str | None) -> Column:
    (cond, label), *rest = cases
    chain = reduce(lambda c, case: c.when(*case), rest, F.when(cond, label))
    return chain.otherwise(F.lit(default))


def map_by_list(c: Column, groups: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """Label of the group whose list holds the text exactly."""
    return _first_match([(c.isin(*texts), label) for label, texts in groups.items()], default)


def map_by_contains(
    c: Column, needles: Sequence[tuple[str, str]], default: str | None
) -> Column:
    """Label of the first needle the text contains; null text takes the default."""
    return _first_match([(c.contains(needle), label) for needle, label in needles], default)


def map_by_regex(c: Column, pattern: str, default: str | None) -> Column:
    """First match of ``pattern`` in the text."""
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")), F.lit(default))


def text_flags(c: Column, texts: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """One 0/1 column per name: is the text one of the name's texts?"""
    return {
        name: F.when(c.isin(*values), 1).otherwise(0) for name, values in texts.items()
    }


def classify_flags(flags: Mapping[str, Column], default: str = "none") -> Column:
    """Name of the first flag, in the given order, that is 1."""
    return _first_match([(flag == 1, name) for name, flag in flags.items()], default)
