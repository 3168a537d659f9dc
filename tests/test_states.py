"""Merged states and sketches against one pass over all rows."""

from datetime import datetime as dt
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import fixed_values as fixed
from cohortlens.operators import sketches as sk
from cohortlens.operators import states as st
from cohortlens.operators import status
from cohortlens.operators.counts import value_counts
from cohortlens.operators.distributions import describe_counts, describe_numeric, histogram_auto, histogram_auto_counts
from cohortlens.operators.titles import titles_in_chunks, titles_per_group
from cohortlens.operators.versions import version_stats
from tests.conftest import values

T0 = dt(2150, 1, 1)
FLAGS = list(fixed.CODE_STATUS_TEXTS)


@pytest.fixture(scope="module")
def measured(spark):
    rng = np.random.default_rng(4)
    rows = [
        (None if k == 9 else int(k), None if i % 50 == 0 else float(v))
        for i, (k, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 9], 20_000), rng.lognormal(2, 1, 20_000)))
    ]
    return spark.createDataFrame(rows, "g long, v double")


def split(df, seed=0):
    """Batches of random size and order, one of them empty."""
    part = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(7))
    return [df.filter(part < 1), df.filter(part >= 5), df.filter((part >= 1) & (part < 5)), df.limit(0)]


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# sketches


def test_merged_quantiles_keep_their_rank_error(spark, measured):
    merged = sk.merge_quantile_sketches(*[sk.quantile_sketch(b, "v", ["g"]) for b in split(measured)], by=["g"])
    probs = {f"p{i}": i / 20 for i in range(1, 20)}
    estimates = sk.sketch_quantiles(merged, probs, ["g"])
    assert estimates.count() == 3
    ranks = sk.quantile_ranks(measured, "v", estimates, probs, ["g"]).collect()
    data = {}
    for row in measured.filter("v IS NOT NULL").collect():
        data.setdefault(row["g"], []).append(row["v"])
    assert len(ranks) == 3 * 19
    for r in ranks:
        own = np.array(data[r["g"]])
        assert r["n_values"] == len(own)
        assert r["rank_lo"] == pytest.approx((own < r["estimate"]).mean())
        assert r["rank_hi"] == pytest.approx((own <= r["estimate"]).mean())
        assert r["rank_lo"] - sk.rank_error() <= r["prob"] <= r["rank_hi"] + sk.rank_error()
    whole = {r["g"]: (r["n_values"], r["min"], r["max"]) for r in merged.collect()}
    assert whole == {g: (len(v), min(v), max(v)) for g, v in data.items()}


def test_larger_sketches_are_closer():
    assert sk.rank_error(200) < 0.02 and sk.rank_error(800) < 0.01
    assert sk.distinct_error(14) < sk.distinct_error(12) < 0.05


def test_sketches_of_nothing(spark, measured):
    empty = measured.limit(0)
    assert sk.quantile_sketch(empty, "v", ["g"]).count() == 0
    assert sk.quantile_sketch(empty, "v").count() == 0
    only_missing = spark.createDataFrame([(1, None), (1, float("nan"))], "g long, v double")
    assert sk.quantile_sketch(only_missing, "v", ["g"]).count() == 0
    assert values(sk.distinct_estimates(sk.distinct_sketch(only_missing.select("g", F.col("v").cast("string")).filter("v IS NULL"), "v", ["g"]), ["g"])) == [(1, 1, 0)]
    with pytest.raises(ValueError):
        sk.distinct_sketch(empty, "v", kind="other")
    with pytest.raises(ValueError):
        sk.merge_quantile_sketches()


@pytest.mark.parametrize("kind", ["hll", "theta"])
def test_merged_distinct_counts(spark, kind):
    df = spark.range(60_000).selectExpr("id % 3 AS g", "cast(id % (5000 * (id % 3 + 1)) AS string) AS x")
    states = [sk.distinct_sketch(b, "x", ["g"], kind) for b in split(df)]
    merged = sk.merge_distinct_sketches(*states, by=["g"], kind=kind)
    truth = dict(values(df.groupBy("g").agg(F.count_distinct("x"))))
    for g, n_rows, n in values(sk.distinct_estimates(merged, ["g"], kind)):
        assert n_rows == 20_000 and abs(n - truth[g]) <= sk.distinct_error() * truth[g]


def test_new_values_by_difference(spark):
    first = spark.range(3000).selectExpr("1 AS g", "cast(id AS string) AS x")
    later = spark.range(2000, 3500).selectExpr("1 AS g", "cast(id AS string) AS x").union(
        spark.createDataFrame([(2, "a"), (None, "b")], "g int, x string")
    )
    sketch = lambda df: sk.distinct_sketch(df, "x", ["g"], "theta")
    got = {r["g"]: (r["n_distinct"], r["n_new"]) for r in sk.new_values(sketch(later), sketch(first), ["g"]).collect()}
    assert got == {1: (1500, 500), 2: (1, 1), None: (1, 1)}  # exact up to the number of entries
    total = sk.new_values(sk.distinct_sketch(later, "x", kind="theta"), sk.distinct_sketch(first, "x", kind="theta"))
    assert values(total) == [(1502, 502)]


# states


@pytest.mark.parametrize("seed", [0, 1])
def test_counts_of_batches(spark, measured, seed):
    merged = st.merge_counts(*[value_counts(b, "v", ["g"]) for b in split(measured, seed)], by=["g"])
    assert same(merged, value_counts(measured, "v", ["g"]))
    rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in df.dtypes])
    assert same(rounded(describe_counts(merged, ["g"])), rounded(describe_numeric(measured, "v", ["g"])))
    assert same(histogram_auto_counts(merged, 30, ["g"]), histogram_auto(measured, "v", 30, ["g"]))


def notes(spark):
    rng = np.random.default_rng(8)
    rows = [
        (int(k) or None, None if t == 5 else f"text {t}", T0 + timedelta(hours=int(h)))
        for k, t, h in zip(rng.integers(0, 40, 3000), rng.integers(0, 6, 3000), rng.integers(0, 99, 3000))
    ]
    return spark.createDataFrame(rows, "k long, text string, at timestamp_ntz")


def test_versions_of_batches(spark):
    df = notes(spark)
    states = [st.version_state(b, ["k"], "text", "at") for b in split(df)]
    merged = st.merge_version_states(*states, keys=["k"])
    # merging again, in another order and grouping, changes nothing
    again = st.merge_version_states(st.merge_version_states(states[2], states[0], keys=["k"]), states[1], keys=["k"])
    assert same(merged, again)
    assert same(st.version_stats_of(merged, ["k"]), version_stats(df, ["k"], "text", "at"))


def test_saved_batches_replace_themselves(spark, tmp_path):
    df, path = notes(spark), str(tmp_path / "state")
    batches = split(df)
    st.save_batch(st.version_state(batches[1], ["k"], "text", "at"), path, "day-1")  # to be replaced
    for i, batch in enumerate(batches):
        st.save_batch(st.version_state(batch, ["k"], "text", "at"), path, f"day-{i}")
    merged = st.merge_version_states(st.saved_batches(spark, path), keys=["k"])
    assert same(st.version_stats_of(merged, ["k"]), version_stats(df, ["k"], "text", "at"))
    assert st.saved_batches(spark, path, ["k", "n"]).columns == ["k", "n"]
    for bad in ("", "a/b", "..=x"):
        with pytest.raises(ValueError):
            st.save_batch(df, path, bad)


EVENTS = "icustay_id long, itemid int, charttime timestamp_ntz, value string, error int"


def test_late_status_events_in_any_batch(spark):
    rng = np.random.default_rng(6)
    texts = [t for group in fixed.CODE_STATUS_TEXTS.values() for t in group] + ["Other/Remarks", "what", None]
    rows = [
        (int(s) or None, 128, None if h > 90 else T0 + timedelta(hours=int(h)), texts[t], int(e) if e < 2 else None)
        for s, h, t, e in zip(
            rng.integers(0, 30, 2000), rng.integers(0, 100, 2000), rng.integers(0, len(texts), 2000), rng.integers(0, 3, 2000)
        )
    ]
    events = spark.createDataFrame(rows, EVENTS)
    stays = spark.createDataFrame([(1, 1, i, T0) for i in range(40)], "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz")
    how = (fixed.CODE_STATUS_ITEMS, fixed.CODE_STATUS_TEXTS, fixed.CODE_STATUS_IGNORED_TEXTS)
    whole = status.status_timeline(stays, events, *how)
    for seed in range(2):
        parts = [status.timeline_state(b, *how) for b in split(events, seed)]
        merged = status.merge_timeline_states(*parts[::-1], flags=FLAGS)
        assert same(status.timeline_of(stays, merged, FLAGS), whole)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_stays_keep_to_many_tasks(spark, setting, broadcast):
    # adaptive execution would join all of these few rows into one task to a core
    setting("spark.sql.shuffle.partitions", "40")
    setting("spark.sql.autoBroadcastJoinThreshold", broadcast)
    at = "timestampadd(HOUR, cast(id % 50 AS int), timestamp_ntz'2150-01-01')"
    stays = spark.range(20_000).selectExpr("id % 90 AS subject_id", "id % 900 AS hadm_id", "if(id = 7, null, id) AS icustay_id", f"{at} AS intime")
    events = spark.range(300).selectExpr("id * 3 AS icustay_id", "128 AS itemid", f"{at} AS charttime", "'Full Code' AS value", "0 AS error")
    timeline = status.status_timeline(stays.union(stays), events, fixed.CODE_STATUS_ITEMS, fixed.CODE_STATUS_TEXTS)
    tasks = timeline.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count("fullcode").alias("charted")).collect()
    assert len(tasks) >= 40 and max(r["n"] for r in tasks) < 20_000 / 10
    assert sum(r["n"] for r in tasks) == 20_000 and sum(r["charted"] for r in tasks) == 300
    latest = status.status_per_admission(status.classify_status(timeline, fixed.CODE_STATUS_PRIORITY))
    assert latest.count() == 900


# titles in chunks


@pytest.mark.parametrize("distinct", [True, False])
def test_chunks_make_the_whole_text(spark, distinct):
    rng = np.random.default_rng(3)
    codes = [(int(k) or None, str(c)) for k, c in zip(rng.integers(0, 5, 3000), rng.zipf(1.5, 3000) % 90)]
    titles = [(str(c), None if c == 3 else f"{'Acute' if c % 2 else 'Éz'} {c % 70}") for c in range(90)]
    codes = spark.createDataFrame([*codes, (77, "3")], "hadm_id long, icd9_code string")
    dictionary = spark.createDataFrame(titles, "icd9_code string, long_title string")
    chunks = titles_in_chunks(codes, dictionary, "hadm_id", "|", distinct, per_chunk=7).collect()
    whole = {r["hadm_id"]: r["titles"] for r in titles_per_group(codes, dictionary, "hadm_id", "|", distinct).collect()}
    got = {}
    for r in sorted(chunks, key=lambda r: (str(r["hadm_id"]), r["chunk"])):
        assert r["n"] == len(r["titles"].split("|")) <= 7
        got.setdefault(r["hadm_id"], []).append(r["titles"])
    assert {k: "|".join(v) for k, v in got.items()} == {k: v for k, v in whole.items() if v is not None}
    assert whole[77] is None and 77 not in got


def test_a_title_coded_very_often_is_cut(spark):
    codes = spark.range(0, 200_000, 1, 8).selectExpr("1L AS hadm_id", "if(id % 9 = 0, 'b', 'a') AS icd9_code")
    dictionary = spark.createDataFrame([("a", "first"), ("b", "second")], "icd9_code string, long_title string")
    rows = titles_in_chunks(codes, dictionary, "hadm_id", ",", False).orderBy("chunk").collect()
    assert [r["n"] for r in rows] == [1000] * 200
    assert rows[0]["titles"] == ",".join(["first"] * 1000) and rows[-1]["titles"] == ",".join(["second"] * 1000)
