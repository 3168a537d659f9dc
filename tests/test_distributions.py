import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.counts import value_counts, with_dense_rank
from cohortlens.operators.distributions import (
    box_stats,
    density_2d,
    describe_numeric,
    histogram_auto,
    histogram_fixed,
    quantiles,
)
from tests.conftest import values


def frame(spark, rows, ddl="g string, v double"):
    return spark.createDataFrame(rows, ddl)


def test_value_counts_and_missing(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", None), ("a", float("nan")), (None, 2.0)])
    assert values(value_counts(df, "v", ["g"]), "g", "value") == [(None, 2.0, 1), ("a", 1.0, 2)]
    assert values(value_counts(df, "v", ["g"], keep_missing=True), "g", "value") == [
        (None, 2.0, 1),
        ("a", None, 2),
        ("a", 1.0, 2),
    ]


def test_fixed_histogram_edges(spark):
    rows = [("a", v) for v in (-1.0, 0.0, 2.999, 3.0, 257.9, 258.0, 259.0, None, float("nan"))]
    bins = {r["bin"]: r for r in histogram_fixed(frame(spark, rows), "v", 0, 3, 86).collect()}
    assert len(bins) == 86
    assert {b: r["n"] for b, r in bins.items() if r["n"]} == {0: 2, 1: 1, 85: 2}
    assert (bins[85]["lo"], bins[85]["hi"]) == (255.0, 258.0)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_auto_histogram_matches_numpy(spark, by):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(50, 20, 500).round(1), "b": np.full(7, 4.0)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    got = histogram_auto(frame(spark, rows), "v", 30, by).toPandas()
    groups = data if by else {"all": np.concatenate(list(data.values()))}
    for g, vs in groups.items():
        n, edges = np.histogram(vs, bins=30)
        mine = (got[got.g == g] if by else got).sort_values("bin")
        assert mine.n.tolist() == n.tolist()
        assert np.allclose(mine.lo, edges[:-1]) and np.allclose(mine.hi, edges[1:])


def test_equal_values_widen_the_range(spark):
    got = values(histogram_auto(frame(spark, [("a", 4.0)] * 3), "v", 4, ["g"]), "bin")
    assert got == [("a", 0, 3.5, 3.75, 0), ("a", 1, 3.75, 4.0, 0), ("a", 2, 4.0, 4.25, 3), ("a", 3, 4.25, 4.5, 0)]


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_match_numpy(spark, setting, broadcast, by):
    setting("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rng = np.random.default_rng(7)
    data = {
        "wide": np.concatenate([rng.normal(0, 1e9, 200), rng.normal(0, 1e-3, 200), [0.0, -0.0]]),
        "tied": rng.integers(0, 5, 300).astype(float),
        "one": np.array([3.25]),
        "two": np.array([1.0, 2.0]),
        None: rng.uniform(-5, 5, 50),
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    probs = {"p0": 0.0, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p999": 0.999, "p1": 1.0}
    got = quantiles(value_counts(frame(spark, rows), "v", by), probs, by).collect()
    groups = data if by else {"all": np.concatenate(list(data.values()))}
    assert len(got) == len(groups)
    for row in got:
        vs = groups[row["g"]] if by else groups["all"]
        assert np.allclose([row[p] for p in probs], np.quantile(vs, list(probs.values())), rtol=1e-12)


def test_describe_matches_pandas(spark):
    got = describe_numeric(frame(spark, [("a", v) for v in (1.0, 2.0, 3.0, 10.0, None)]), "v").first()
    expected = pd.Series([1.0, 2.0, 3.0, 10.0]).describe()
    assert np.allclose(list(got), expected.tolist())
    assert got["std"] == pytest.approx(4.08248290463863)
    assert (got["q1"], got["median"], got["q3"]) == (1.75, 2.5, 4.75)


def test_describe_of_one_and_of_far_off_values(spark):
    rows = [("one", 5.0)] + [("far", 1e9 + x) for x in (0.0, 1.0, 2.0)]
    got = {r["g"]: r for r in describe_numeric(frame(spark, rows), "v", ["g"]).collect()}
    assert got["one"]["std"] is None and got["one"]["median"] == 5.0
    assert got["far"]["std"] == 1.0


def test_describe_of_nothing(spark):
    got = describe_numeric(frame(spark, [("a", None)]), "v").first()
    assert got["n_values"] == 0 and got["mean"] is None and got["median"] is None


def test_density(spark):
    df = spark.createDataFrame([(1.2, 9.9), (1.9, 9.1), (-0.5, 0.0), (None, 1.0)], "x double, y double")
    assert values(density_2d(df, "x", "y", 1, 3), "x_bin") == [(-1, 0, 1), (1, 3, 2)]


def box_by_hand(vs, whis=1.5):
    q1, med, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
    lo, hi = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
    inside = vs[(vs >= lo) & (vs <= hi)]
    return len(vs), q1, med, q3, min(inside.min(), q1), max(inside.max(), q3), len(vs) - len(inside)


def test_box_stats(spark):
    rng = np.random.default_rng(11)
    data = {
        "tails": np.concatenate([rng.normal(0, 1, 200), [30.0, -40.0]]),
        "clipped": np.array([0.0, 10.0, 10.0, 10.0]),
        "same": np.full(5, 2.0),
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    for row in box_stats(frame(spark, rows), "v", ["g"]).collect():
        assert np.allclose(list(row)[1:], box_by_hand(data[row["g"]]))


def test_dense_rank(spark):
    rows = [(1, "2020-01-02 08:00:00"), (1, "2020-01-02 08:00:00"), (1, "2020-01-02 09:00:00"),
            (1, "2020-01-05 00:00:00"), (1, None), (1, None), (2, None),
            (None, "2020-01-03 00:00:00"), (None, "2020-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = with_dense_rank(df, ["k"], "t", "r").select("k", "r").orderBy("k", "r").collect()
    assert [tuple(r) for r in got] == [
        (None, 1), (None, 2), (1, 1), (1, 1), (1, 2), (1, 3), (1, 4), (1, 4), (2, 1)]
