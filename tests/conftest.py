import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Set session options for one test."""
    changed = []

    def change(key, value):
        changed.append((key, spark.conf.get(key, None)))
        spark.conf.set(key, value)

    yield change
    for key, value in reversed(changed):
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def values(df, *order):
    """Rows as plain tuples, ordered by the given columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
