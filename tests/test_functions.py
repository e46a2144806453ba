import datetime as dt

from pyspark.sql import functions as F

from outagelab.functions import (
    case_date_filter, clean_sentinels, epoch_day, epoch_range, fill_unknown, first_integer, null_if_unknown, percent,
    reconcile_days, recode_display_name, recode_system_type, whole_days, zone_bounds,
)


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_recodes(spark):
    names = spark.createDataFrame(
        [("TV Screen",), ("Waiting Room Screen",), ("UnregisteredTablet",), ("Infusion Room Tablet",),
         ("Wallboard",), (None,)], "n STRING")
    assert values(names, recode_display_name("n")) == ["WRTV", "WRTV", "TABLET", "IRT", "WALLBOARD", None]
    types = spark.createDataFrame(
        [("AndroidMediaPlayer",), ("LinuxMediaPlayer",), ("InfusionRoomTablet",), ("Tablet",), ("Wallboard",), (None,)],
        "n STRING")
    assert values(types, recode_system_type("n")) == ["WRTV", "WRTV", "IRT", "TABLET", "WALLBOARD", None]


def test_sentinels_are_one_list_for_both_cohorts(spark):
    df = spark.createDataFrame([("nil",), ("NOT INSTALLED",), ("[APK NOT INSTALLED]",), ("None",), (None,), ("4.1",)],
                               "v STRING")
    cleaned = values(df, clean_sentinels("v"))
    assert cleaned == ["unknown"] * 5 + ["4.1"]
    assert values(df, null_if_unknown(clean_sentinels("v"))) == [None] * 5 + ["4.1"]


def test_fill_unknown_on_mixed_types(spark):
    df = spark.createDataFrame([(None, None), (1.5, True)], "a DOUBLE, b BOOLEAN")
    assert [tuple(r) for r in fill_unknown(df, ["a", "b"]).collect()] == [("unknown", "unknown"), ("1.5", "true")]


def test_epoch_range_is_half_open_in_the_zone(spark):
    lo, hi = zone_bounds("2020-06-01", "2020-11-30", "US/Central")
    assert lo == int(dt.datetime(2020, 6, 1, 5, tzinfo=dt.UTC).timestamp())   # daylight time
    assert hi == int(dt.datetime(2020, 11, 30, 6, tzinfo=dt.UTC).timestamp())  # standard time
    df = spark.createDataFrame([(lo - 1,), (lo,), (hi - 1,), (hi,)], "t BIGINT")
    assert values(df, epoch_range(F.col("t"), "2020-06-01", "2020-11-30", "US/Central")) == [False, True, True, False]


def test_epoch_day_ignores_the_session_zone(spark):
    t = int(dt.datetime(2020, 6, 1, 23, 30, tzinfo=dt.UTC).timestamp())
    df = spark.createDataFrame([(t,)], "t BIGINT")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(df, epoch_day(F.col("t"))) == [dt.date(2020, 6, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_last_day_of_a_timestamp_window(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 11, 30, 0, 0),), (dt.datetime(2020, 11, 30, 10, 0),)], "t TIMESTAMP")
    assert values(df, case_date_filter(F.col("t"), "2020-06-01", "2020-11-30")) == [True, True]
    assert values(df, case_date_filter(F.col("t"), "2020-06-01", "2020-11-30", False)) == [True, False]


def test_durations(spark):
    df = spark.createDataFrame([("off for 3 days, 2 h",), ("off",), (None,), ("99999999999",)], "m STRING")
    assert values(df, first_integer(F.col("m"))) == [3, None, None, None]
    df = spark.createDataFrame([(None, 3), (5, 3), (0, 3), (2, 3), (4, None), (0, None)], "a INT, b INT")
    assert values(df, reconcile_days(F.col("a"), F.col("b"))) == [3, 5, 0, None, None, 0]
    df = spark.createDataFrame([(172799,), (1440,), (None,)], "m BIGINT")
    assert values(df, whole_days(F.col("m"))) == [1, 0, None]
    assert values(df, whole_days(F.col("m"), "minutes")) == [119, 1, None]


def test_percent_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 4), (1, 0)], "a INT, b INT")
    assert values(df, percent(F.col("a"), F.col("b"))) == [25.0, None]
