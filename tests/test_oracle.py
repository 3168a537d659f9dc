"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries
from cohortlens.plans import ANALYSES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


def test_every_query_has_sql():
    assert set(ANALYSES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_query_matches_sql(spark, duck, name):
    assert check_oracle.compare(spark, duck, SF, name) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["bucket", "n", "n_abnormal", "pct_abnormal"] and df.count() > 0
