import pytest

from cohortlens.operators.relations import (
    exclude_by,
    keep_by,
    latest_per_key,
    lookup_with_default,
    not_in,
    sample_rows,
)
from tests.conftest import values

KEYS = "k long, x string"


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "k long")


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], KEYS)


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
@pytest.mark.parametrize(
    "other, kept", [((2,), "ac"), ((2, 2, 9), "ac"), ((2, None), ""), ((None,), ""), ((), "abcd")]
)
def test_not_in_follows_sql(spark, setting, rows, broadcast, other, kept):
    setting("spark.sql.autoBroadcastJoinThreshold", broadcast)
    others = keys(spark, *other)
    assert "".join(r["x"] for r in not_in(rows, others, "k").orderBy("x").collect()) == kept
    rows.createOrReplaceTempView("rows_left")
    others.createOrReplaceTempView("rows_right")
    sql = "SELECT x FROM rows_left WHERE k NOT IN (SELECT k FROM rows_right) ORDER BY x"
    assert "".join(r["x"] for r in spark.sql(sql).collect()) == kept


def test_semi_and_anti_split_the_rows(spark, rows):
    other = keys(spark, 2, 2, None)
    assert values(keep_by(rows, other, "k")) == [(2, "b")]
    assert values(exclude_by(rows, other, "k"), "x") == [(1, "a"), (3, "c"), (None, "d")]


def test_lookup_with_default(spark, rows):
    lookup = spark.createDataFrame([(1, "one"), (2, None)], "k long, name string")
    got = lookup_with_default(rows, lookup, "k", "name", "unk")
    assert values(got.select("x", "name"), "x") == [
        ("a", "one"), ("b", "unk"), ("c", "unk"), ("d", "unk")
    ]


def test_latest_keeps_ties_and_drops_missing_times(spark):
    df = spark.createDataFrame(
        [(1, 5, "a"), (1, 9, "b"), (1, 9, "c"), (2, None, "d"), (None, 1, "e")],
        "k long, t long, x string",
    )
    assert values(latest_per_key(df, "k", "t"), "x") == [(1, 9, "b"), (1, 9, "c")]
    assert values(latest_per_key(df, "k", "t", ties=False, tie_breakers=["x"])) == [(1, 9, "c")]


def test_sample_is_repeatable(spark):
    df = keys(spark, *range(100))
    first = values(sample_rows(df, "k", 5, 1))
    assert first == values(sample_rows(df.repartition(7), "k", 5, 1))
    assert len(first) == 5 and first != values(sample_rows(df, "k", 5, 2))
