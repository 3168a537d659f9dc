from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cohortlens import fixed_values as fixed
from cohortlens.functions import (
    abnormal_flag,
    age_years,
    bin_index,
    classify_flags,
    elapsed_days,
    elapsed_minutes,
    half_hour_bucket,
    los_days,
    map_by_contains,
    map_by_list,
    map_by_regex,
    shift_of,
    text_flags,
    to_number_lenient,
)

TIMES = "a timestamp_ntz, b timestamp_ntz"


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], TIMES)


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "dob, t, age",
    [
        (dt(2000, 2, 29), dt(2001, 2, 28), 0),
        (dt(2000, 2, 29), dt(2001, 3, 1), 1),
        (dt(2000, 3, 15, 10), dt(2020, 3, 15, 8), 19),
        (dt(2000, 3, 15, 10), dt(2020, 3, 15, 10), 20),
        (dt(1850, 1, 1), dt(2150, 6, 1), 300),
        (dt(2020, 3, 15), dt(2018, 6, 1), -1),
        (dt(2020, 3, 15), dt(2019, 6, 1), 0),
        (dt(2000, 3, 10, 2, 30), dt(2024, 3, 10, 2, 30), 24),
        (None, dt(2024, 3, 10), None),
    ],
)
def test_calendar_age(spark, setting, zone, dob, t, age):
    setting("spark.sql.session.timeZone", zone)
    assert one(pair(spark, dob, t), age_years(F.col("b"), F.col("a"))) == age


def test_age_methods_differ(spark):
    df = pair(spark, dt(2000, 1, 1, 12), dt(2018, 1, 1, 6))
    ages = {m: one(df, age_years(F.col("b"), F.col("a"), m)) for m in ("days", "dates", "epoch")}
    assert ages["days"] == 6574 / 365.25
    assert ages["dates"] == 6575 / 365.25
    assert ages["epoch"] == round((6574 + 0.75) / 365, 8)
    with pytest.raises(ValueError):
        age_years(F.col("b"), F.col("a"), "lunar")


@pytest.mark.parametrize("method", ["calendar", "days", "dates", "epoch"])
def test_three_hundred_years_do_not_overflow(spark, method):
    df = pair(spark, dt(1850, 1, 1), dt(2150, 6, 1))
    assert 300 <= one(df, age_years(F.col("b"), F.col("a"), method)) < 301


@pytest.mark.parametrize(
    "seconds, days", [(198_673, 2.29945602), (-198_673, -2.29945602), (0, 0.0), (432, 0.005)]
)
def test_los_days_keeps_eight_places(spark, seconds, days):
    start = dt(2020, 1, 1)
    end = start + timedelta(seconds=seconds)
    df = pair(spark, start, end)
    assert one(df, los_days(F.col("a"), F.col("b"))) == days
    assert one(df, los_days(F.col("a"), F.col("b"), 2)) == round(days, 2)


def test_los_days_rounds_half_away_from_zero(spark):
    df = pair(spark, dt(2020, 1, 1), dt(2020, 1, 1, 0, 0, 0, 432))
    assert one(df, los_days(F.col("a"), F.col("b"))) == 1e-8
    assert one(df, los_days(F.col("b"), F.col("a"))) == -1e-8


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_elapsed(spark, setting, zone):
    setting("spark.sql.session.timeZone", zone)
    df = pair(spark, dt(2020, 1, 1), dt(2020, 1, 1, 0, 10, 30))
    assert one(df, elapsed_minutes(F.col("a"), F.col("b"))) == 10.5
    assert one(df, elapsed_minutes(F.col("b"), F.col("a"))) == -10.5
    gap = pair(spark, dt(2024, 3, 10, 2, 30), dt(2024, 3, 10, 3, 30))
    assert one(gap, elapsed_minutes(F.col("a"), F.col("b"))) == 60.0


@pytest.mark.parametrize(
    "b, days",
    [
        (dt(2019, 12, 31, 12), -1),
        (dt(2020, 1, 1), 0),
        (dt(2019, 12, 31), -1),
        (dt(2020, 1, 2, 23, 59, 59, 999999), 1),
        (dt(2019, 12, 31, 23, 59, 59, 999999), -1),
        (dt(2320, 1, 1), (dt(2320, 1, 1) - dt(2020, 1, 1)).days),
    ],
)
def test_elapsed_days_round_down(spark, b, days):
    assert one(pair(spark, dt(2020, 1, 1), b), elapsed_days(F.col("a"), F.col("b"))) == days


@pytest.mark.parametrize(
    "text, number",
    [(t, None) for t in ("80d", "80f", "80D", "NaN", "", "abc", "inf", "0x1p3", "1e", None)]
    + [(" 80 ", 80.0), ("1e2", 100.0), (".5", 0.5), ("5.", 5.0), ("-3", -3.0), ("+4E-1", 0.4)],
)
def test_lenient_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert one(df, to_number_lenient(F.col("v"))) == number


def test_abnormal_null_policies(spark):
    df = spark.createDataFrame([(None,), (5.0,), (20.0,), (4.5,), (11.0,)], "v double")
    flags = lambda policy: [
        r[0] for r in df.select(abnormal_flag(F.col("v"), 4.5, 11.0, policy)).collect()
    ]
    assert flags("drop") == [None, 0, 1, 0, 0]
    assert flags("abnormal") == [1, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        flags("ignore")


def test_bin_edges_decide(spark):
    # 0.7 / 0.1 is 6.999..., but 0.7 is not below the edge 7 * 0.1 = 0.7000000000000001.
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.7, 0.7000000000000001, 1.0)], "v double")
    bins = [r[0] for r in df.select(bin_index(F.col("v"), F.lit(0.0), F.lit(0.1), 10)).collect()]
    edges = [i * 0.1 for i in range(11)]
    expected = [
        max(i for i in range(10) if edges[i] <= x) for x in (0.0, 0.3, 0.7, 0.7000000000000001, 1.0)
    ]
    assert bins == expected


def test_half_hours_and_shifts(spark):
    times = [dt(2020, 1, 1, 0, 29), dt(2020, 1, 1, 7, 30), dt(2020, 1, 1, 8), dt(2020, 1, 1, 16), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = df.select(half_hour_bucket(F.col("t")), shift_of(F.col("t")), shift_of(F.col("t"), "Evening"))
    assert [tuple(r) for r in got.collect()] == [
        (0.0, "Night", "Night"),
        (7.5, "Night", "Night"),
        (8.0, "Day", "Day"),
        (16.0, "Evening", "Evening"),
        (None, None, "Evening"),
    ]


def test_three_race_groupings(spark):
    texts = ["SOUTH AMERICAN", "UNABLE TO OBTAIN", "ASIAN - ASIAN INDIAN", "PORTUGUESE", None,
             "CARIBBEAN ISLAND", "WHITE - RUSSIAN"]
    df = spark.createDataFrame([(t,) for t in texts], "e string")
    got = df.select(
        map_by_list(F.col("e"), fixed.ETHNICITY_GROUPS, "other"),
        map_by_contains(F.col("e"), fixed.RACE_BY_TEXT, "Other"),
        map_by_regex(F.col("e"), fixed.RACE_PATTERN, "OTHER"),
    )
    assert [tuple(r) for r in got.collect()] == [
        ("other", "Hispanic", "OTHER"),
        ("unknown", "Other", "OTHER"),
        ("asian", "Asian", "ASIAN"),
        ("other", "Other", "OTHER"),
        ("other", "Other", "OTHER"),
        ("black", "Other", "OTHER"),
        ("white", "White", "WHITE"),
    ]


def test_status_texts_and_priority(spark):
    df = spark.createDataFrame([("DNR / DNI",), ("Full code",), ("other",), (None,)], "v string")
    flags = text_flags(F.col("v"), fixed.CODE_STATUS_TEXTS)
    ordered = {name: flags[name] for name in fixed.CODE_STATUS_PRIORITY}
    got = df.select(flags["dnr"], flags["dni"], flags["cmo"], classify_flags(ordered))
    assert [tuple(r) for r in got.collect()] == [
        (1, 1, 0, "dnr"),
        (0, 0, 0, "fullcode"),
        (0, 0, 0, "none"),
        (0, 0, 0, "none"),
    ]


def test_expressions_work_on_streams(spark, tmp_path):
    spark.createDataFrame([(dt(2020, 1, 1, 7, 30),)], "t timestamp_ntz").write.parquet(
        str(tmp_path / "in")
    )
    stream = spark.readStream.schema("t timestamp_ntz").parquet(str(tmp_path / "in"))
    query = (
        stream.select(half_hour_bucket(F.col("t")).alias("b"), shift_of(F.col("t")).alias("s"))
        .writeStream.format("memory")
        .queryName("expressions_on_streams")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("expressions_on_streams").collect()] == [(7.5, "Night")]
