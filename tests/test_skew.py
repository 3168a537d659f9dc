"""A third of all rows under one key: answers against brute force, and split work.

The plans are made without adaptive execution or broadcasts, so nothing but the
operators themselves spreads the hot key.
"""

from collections import Counter, defaultdict
from datetime import datetime as dt
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import fixed_values as fixed
from cohortlens.operators.counts import with_dense_rank
from cohortlens.operators.distributions import box_stats, histogram_auto
from cohortlens.operators.ordering import audit_order
from cohortlens.operators.relations import latest_per_key
from cohortlens.operators.status import status_timeline
from cohortlens.operators.survival import kaplan_meier
from cohortlens.operators.titles import titles_per_group
from cohortlens.operators.versions import version_stats
from cohortlens.operators.vitals import summarise_vitals, vital_values

N = 6000
T0 = dt(2150, 1, 1)


@pytest.fixture(autouse=True)
def bare(setting):
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.fixture(scope="module")
def hot():
    """(key, step) pairs: key 0 holds a third of the rows."""
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(N) < 1 / 3, 0, rng.integers(1, 400, N))
    return [(int(k), int(s)) for k, s in zip(keys, rng.integers(0, 2000, N))]


def rows_per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_dense_rank_of_a_hot_key(spark, hot):
    df = spark.createDataFrame([(k, T0 + timedelta(hours=s)) for k, s in hot], "k long, t timestamp_ntz")
    got = with_dense_rank(df, ["k"], "t", "r").select("k", "t", "r").collect()
    times = defaultdict(set)
    for k, s in hot:
        times[k].add(s)
    rank = {(k, T0 + timedelta(hours=s)): i for k, ss in times.items() for i, s in enumerate(sorted(ss), 1)}
    assert Counter(map(tuple, got)) == Counter((*(k, T0 + timedelta(hours=s)), rank[k, T0 + timedelta(hours=s)]) for k, s in hot)


@pytest.mark.parametrize("key", [0, None])
def test_ranked_rows_of_a_hot_key_are_spread(spark, hot, key):
    rows = [(k or key, T0 + timedelta(hours=s)) for k, s in hot]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz")
    ranked = with_dense_rank(df, ["k"], "t", "r").filter(F.col("k").eqNullSafe(key))
    # The rank is read, or its windows would be pruned from the measured plan.
    tasks = ranked.groupBy(F.spark_partition_id()).agg(F.count("r").alias("n")).collect()
    sizes = [r["n"] for r in tasks]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_undated_rows_of_a_hot_key_rank_last_and_are_spread(spark, hot):
    rows = [(k > 0, None if k == 0 else T0 + timedelta(hours=s % 50), i) for i, (k, s) in enumerate(hot)]
    rows += [(False, T0, -1), (False, T0, -2), (False, T0 + timedelta(days=99), -3)]
    df = spark.createDataFrame(rows, "k boolean, t timestamp_ntz, id long")
    ranked = with_dense_rank(df, ["k"], "t", "r")
    undated = ranked.filter("t is null")
    assert undated.select("r").distinct().collect() == [(3,)]
    sizes = [r["n"] for r in undated.groupBy(F.spark_partition_id()).agg(F.count("r").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    assert {(r["t"], r["r"]) for r in ranked.filter("k").collect()} == {(T0 + timedelta(hours=i), i + 1) for i in range(50)}


def test_ranking_reads_its_input_once(spark, hot):
    df = spark.createDataFrame([(k, T0, i) for i, (k, _) in enumerate(hot)], "k long, t timestamp_ntz, id long")
    plan = with_dense_rank(df.repartition(3), ["k"], "t", "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("ReusedExchange") == 1


def test_box_and_histogram_of_a_hot_key(spark, hot):
    rows = [(k % 3, float(s)) for k, s in hot]
    df = spark.createDataFrame(rows, "k long, v double")
    for row in box_stats(df, "v", ["k"]).collect():
        vs = np.array([v for k, v in rows if k == row["k"]])
        assert (row["n"], row["q1"], row["median"], row["q3"]) == (len(vs), *np.quantile(vs, [0.25, 0.5, 0.75]))
    bins = histogram_auto(df, "v", 50, ["k"]).toPandas()
    for k, part in bins.groupby("k"):
        expected, _ = np.histogram([v for kk, v in rows if kk == k], bins=50)
        assert part.sort_values("bin").n.tolist() == expected.tolist()


def test_latest_of_a_hot_key(spark, hot):
    df = spark.createDataFrame(hot, "k long, s long")
    best = {}
    for k, s in hot:
        best[k] = max(best.get(k, -1), s)
    expected = sorted(r for r in hot if best[r[0]] == r[1])
    assert sorted(map(tuple, latest_per_key(df, "k", "s").collect())) == expected


def test_status_of_a_hot_stay(spark, hot):
    texts = [t for ts in fixed.CODE_STATUS_TEXTS.values() for t in ts]
    events = [(k, T0 + timedelta(hours=s), texts[(k + s) % len(texts)]) for k, s in hot]
    df = spark.createDataFrame(events, "icustay_id long, charttime timestamp_ntz, value string").select(
        "*", F.lit(128).alias("itemid"), F.lit(None).cast("int").alias("error")
    )
    stays = spark.range(400).selectExpr("1L subject_id", "id hadm_id", "id icustay_id", "timestamp_ntz'2150-01-01' intime")
    got = status_timeline(stays, df, [128], fixed.CODE_STATUS_TEXTS)
    by_stay = defaultdict(list)
    for k, t, v in events:
        by_stay[k].append((t, v))
    for row in got.collect():
        charted = sorted(by_stay[row["icustay_id"]])
        for name, values in fixed.CODE_STATUS_TEXTS.items():
            if not charted:
                assert row[name] is None
                continue
            assert row[f"{name}_first"] == int(charted[0][1] in values)
            assert row[f"{name}_last"] == int(charted[-1][1] in values)
            assert row[name] == int(any(v in values for _, v in charted))
            assert row[f"{name}_first_charttime"] == min((t for t, v in charted if v in values), default=None)


def test_versions_of_a_hot_note(spark, hot):
    rows = [(k, f"text {s % 50}" if s % 7 else None, T0 + timedelta(hours=s)) for k, s in hot]
    df = spark.createDataFrame(rows, "k long, text string, at timestamp_ntz")
    got = {r["k"]: r for r in version_stats(df, ["k"], "text", "at").collect()}
    for k in {k for k, *_ in rows}:
        texts = [t for kk, t, _ in rows if kk == k]
        assert got[k]["total_versions"] == len(texts)
        assert got[k]["unique_text_versions"] == len(set(texts) - {None})


def test_titles_of_a_hot_admission(spark, hot):
    codes = spark.createDataFrame([(k, str(s % 20)) for k, s in hot], "hadm_id long, icd9_code string")
    titles = spark.createDataFrame([(str(i), f"title {i % 15}") for i in range(20)], "icd9_code string, long_title string")
    for distinct in (True, False):
        got = dict(map(tuple, titles_per_group(codes, titles, "hadm_id", ",", distinct).collect()))
        for k in {k for k, _ in hot}:
            named = [f"title {s % 20 % 15}" for kk, s in hot if kk == k]
            assert got[k] == ",".join(sorted(set(named) if distinct else named))


def test_curve_of_a_hot_group(spark, hot):
    df = spark.createDataFrame([(k, s, (k + s) % 4 > 0) for k, s in hot], "k long, t long, e boolean")
    got = kaplan_meier(df, "t", "e", by=["k"]).filter("k = 0").orderBy("t").collect()
    mine = [(s, (k + s) % 4 > 0) for k, s in hot if k == 0]
    survival = 1.0
    for row, t in zip(got, sorted({s for s, _ in mine})):
        at_risk = sum(s >= t for s, _ in mine)
        died = sum(s == t and e for s, e in mine)
        survival *= 1 - died / at_risk
        assert (row["t"], row["at_risk"], row["events"]) == (t, at_risk, died)
        assert row["survival"] == pytest.approx(survival, rel=1e-9)


@pytest.fixture
def adaptive(bare, setting):
    """Adaptive execution with thresholds low enough to call small partitions skewed."""
    setting("spark.sql.adaptive.enabled", "true")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4KB")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    setting("spark.sql.shuffle.partitions", "16")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_on_a_hot_key_are_split(spark, hot, adaptive, tmp_path):
    # Many map tasks, since a skewed partition is split between map outputs.
    numbered = [(k, i, s) for i, (k, s) in enumerate(hot)]
    spark.createDataFrame(numbered, "k long, i long, s long").repartition(16).write.parquet(str(tmp_path / "hot"))
    rows = spark.read.parquet(str(tmp_path / "hot"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8KB")
    try:
        events = rows.selectExpr(
            "k subject_id", "i hadm_id", "i icustay_id", "211 itemid",
            "timestampadd(HOUR, cast(s as int), timestamp_ntz'2150-01-01') charttime",
            "cast(s as string) value",
        )
        patients = spark.range(400).selectExpr(
            "id subject_id", "'F' gender", "timestamp_ntz'2100-01-01' dob", "timestamp_ntz'2151-01-01' dod"
        )
        summary = summarise_vitals(vital_values(events, patients, [211]))
        assert "SortMergeJoin(skew=true)" in final_plan(summary)
        row = summary.first()
        assert (row["n"], row["median_hr"]) == (N, float(np.median([s for _, s in hot])))

        at = "timestampadd(HOUR, cast({} as int), timestamp_ntz'2150-01-01')"
        stays = rows.selectExpr(
            "k hadm_id", f"{at.format('s')} intime", f"{at.format('s + 5')} outtime"
        )
        admissions = spark.range(400).selectExpr(
            "id hadm_id", f"{at.format(1000)} admittime", f"{at.format(3000)} dischtime"
        )
        audit = audit_order(
            stays.join(admissions, "hadm_id"), "intime", "outtime", "admittime", "dischtime"
        )
        assert "SortMergeJoin(skew=true)" in final_plan(audit)
        assert audit.first()["n_in_before"] == sum(s < 1000 for _, s in hot)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
