"""The study's jobs on small hand-made tables that hold each known trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outagelab.plans import activity as act
from outagelab.plans import cohorts, prepare
from outagelab.plans import variables as var
from outagelab.plans.study import Study
from outagelab.sources import SCHEMAS, audit, load_tables, write_csv, write_stage
from outagelab.sources.readers import read_csv
from outagelab.sources.schemas import struct_of

STUDY = Study(cap=10)


def d(m, day, year=2020):
    return dt.date(year, m, day)


def ts(m, day, hour=0):
    return dt.datetime(2020, m, day, hour)


def ms(m, day, hour=12):
    return int(dt.datetime(2020, m, day, hour, tzinfo=dt.UTC).timestamp()) * 1000


ROWS = {
    "case_reason_codes": [
        ("c1", "W1", "Wallboard", "r", "MIA"), ("c2", "W1", "Wallboard", "r", "mia"), ("c3", "W2", "Wallboard", "r", "MIA"),
        ("c4", "W3", "Wallboard", "r", "Repair"), ("c5", None, "Wallboard", "r", "MIA"), ("c6", "W4", "TV Screen", "r", "MIA"),
    ],
    "case_assets": [
        ("a1", "c1", "W1", "x", d(7, 1), d(7, 10)), ("a2", "c2", "W1", "x", d(8, 1), None),
        ("a3", "c3", "W2", "x", d(5, 1), d(5, 3)), ("a4", "c4", "W3", "x", d(7, 1), d(7, 2)),
        ("a6", "c6", "W4", "x", d(9, 1), d(8, 30)),
    ],
    "cases": [("c1", ts(7, 1, 15), "K1"), ("c2", ts(8, 1, 1), "K1"), ("c3", ts(5, 1), "K2")],
    "assets_history": [
        ("m1", "w1", "installed", "mdm", "1", d(7, 2), "K1", ts(7, 2)), ("m1", "W1", "Installed", "MDM", "1", d(8, 5), "K1", None),
        ("m3", "W3", "INSTALLED", "MDM", "3", d(6, 5), "K1", ts(6, 5)), ("m3", "W3", "Installed", "MDM", "3", d(6, 6), "K1", ts(6, 5, 9)),
        ("m5", "W5", "Installed", "other", "5", d(11, 30), "K9", None), ("m6", "W6", "Installed", "MDM", "6", d(12, 1), "K1", None),
    ],
    "assets": [("W1", "S1", "man", "mod", "cpu", "40"), ("W3", "S2", "man", "mod2", None, "50")],
    "devices": [("1", "CL1", "W1", "Wallboard"), ("3", "CL3", "W3", "Wallboard"), ("5", "CL5", "W5", None)],
    "devices_history": [
        ("W1", "Wallboard", d(6, 24), "4.1", 50.0, True, 10.0), ("W1", "Wallboard", d(6, 30), "4.2", 0.0, None, 20.0),
        ("W1", "Wallboard", d(7, 20), "4.3", 80.0, False, 30.0), ("W3", "Wallboard", d(6, 2), "nil", 20.0, True, 1.0),
        ("W3", "Wallboard", d(6, 9), "4.1", 40.0, False, 2.0), ("W3", "Wallboard", d(6, 9), "4.0", None, None, None),
        ("W9", "Wallboard", d(6, 9), "9", -5.0, True, 1.0),
    ],
    "sku_history": [("S1", d(6, 28)), ("S2", d(6, 1))],
    "poweroff_events": [
        ("W1", ts(7, 1), None, "off for 3 days", None), ("W1", ts(7, 1), ts(7, 2), "off for 1 days", 400000),
        ("W1", ts(11, 30, 10), None, "off for 9 days", None), ("W1", ts(8, 1), None, "no digits", 0),
        ("W1", ts(9, 1), None, "off for 5 days", 100000),
    ],
    "accounts": [("K1", "NY", "Other", 1.0, "T", "Onc", "B")],
    "device_events": [
        ("W1", "e1", "x.ExtendedNetworkOffEvent", ms(11, 29), None, None), ("W1", "e1", "x.ExtendedNetworkOffEvent", ms(11, 29, 13), None, None),
        ("W1", "e2", "x.ExtendedNetworkOffEvent", ms(11, 30, 5), None, None), ("W1", "e3", "x.ExtendedNetworkOffEvent", ms(11, 30, 7), None, None),
        ("W1", "e4", "x.SessionEndEvent", ms(6, 2), "s1", "Timeout"), ("W1", "e5", "x.SessionEndEvent", ms(6, 2, 14), "s1", "Timeout"),
        ("W1", "e6", "x.SessionEndEvent", ms(6, 3), "s2", "Timeout"), ("W1", "e7", "x.SessionEndEvent", ms(6, 3), "s3", "Timeout"),
        ("W1", "e8", "x.SessionEndEvent", ms(6, 3), None, "Crash"), ("W7", "e9", "x.SessionEndEvent", ms(6, 3), "s", "Exit"),
    ],
    "daily_content_displays": [
        (1, ms(6, 2) // 1000, "2020-06-02", "p1", "In Stream", 10, 1.0), (1, ms(6, 2, 15) // 1000, "2020-06-02", "p2", "in  stream", 4, 2.0),
        (1, ms(6, 9) // 1000, "2020-06-09", "p1", "In Stream", 2, 4.0), (1, ms(7, 1) // 1000, "2020-07-01", "p1", "Banner", 7, 9.0),
        (3, ms(8, 1) // 1000, "2020-08-01", "px", "In Stream", 5, 5.0),
    ],
    "sponsors": [("p1", "Acme")],
    "model_interaction": [
        ("W1", "Heart", ms(6, 2) // 1000, ts(6, 2, 12), "2020-06-02"), ("W1", "Heart", ms(6, 2) // 1000, ts(6, 2, 12), "2020-06-02"),
        ("W1", "Heart", ms(6, 3) // 1000, ts(6, 3, 1), "2020-06-03"), ("W1", "Heart", ms(6, 3) // 1000, ts(6, 3, 2), "2020-06-03"),
        ("W3", "Heart", ms(6, 3) // 1000, ts(6, 3, 2), "2020-06-03"), ("W3", "Lung", ms(6, 3) // 1000, ts(6, 3, 2), "2020-06-03"),
    ],
}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("base"))
    for name, rows in ROWS.items():
        write_stage(spark.createDataFrame(rows, struct_of(name)), root, name)
    return load_tables(spark, root)


@pytest.fixture(scope="module")
def cases(t):
    return cohorts.case_cohort(t, STUDY).persist()


@pytest.fixture(scope="module")
def control(t):
    return cohorts.capped_control(cohorts.control_cohort(t, STUDY), STUDY).persist()


def test_schemas_cover_the_fixture():
    assert set(SCHEMAS) == set(ROWS)


def test_case_cohort(cases):
    got = {r.case_id: r for r in cases.collect()}
    # c3 opened before the window, c4 is another type, c5 has no asset, c6 closed before it opened.
    assert set(got) == {"c1", "c2"}
    assert (got["c1"].ams_id, got["c1"].client_id, got["c1"].cmh_id) == ("m1", "CL1", "K1")
    assert got["c2"].ams_id is None and got["c2"].closed_date is None


def test_control_cohort_survives_null_case_assets(t):
    got = {r.asset_tag: r for r in cohorts.control_cohort(t, STUDY).collect()}
    assert set(got) == {"w1", "W3", "W5"}   # W1 had a case; W6 was exported after the window
    assert set(r.asset_tag for r in cohorts.control_cohort(t, STUDY, fold_case=True).collect()) == {"W3", "W5"}
    assert (got["W3"].device_type, got["W5"].device_type, got["W5"].client_id) == ("WALLBOARD", None, None)


def test_cap_leaves_out_unknown_types(control):
    assert sorted(r.asset_tag for r in control.collect()) == ["W3", "w1"]


def test_software_at_the_latest_snapshot(cases, t):
    got = sorted((r.software_version, r.free_disk_space) for r in var.case_software(cases, t, STUDY).collect())
    # First case: seven days back from 1 July; second: since the first one closed on 10 July.
    assert got == [("4.2", 0.0), ("4.3", 80.0)]


def test_hardware_needs_an_export_inside_the_interval(cases, t):
    got = {r.model for r in var.case_hardware(cases, t, STUDY).collect()}
    assert got == {"mod", None}


def test_power_off(t):
    row = var.power_off(t, STUDY).first()
    # 3 (text), 4 (400000 s); 30 Nov 10:00 is outside; 0 does not count; 1 day against 5 is void.
    assert (row.avg_times, row.avg_days) == (3, 3.5)
    assert var.power_off(t, STUDY, end_inclusive_day=True).first().avg_times == 4
    assert var.power_off(t, Study(power_unit="minutes")).first().avg_days > 100


def test_clinic_flag(cases, control, t):
    assert [(r.state, r.clinic_had_mia) for r in var.clinic_attributes(cases, "asset_name", t, STUDY).collect()] == [("NY", 1)]
    got = {r.asset_name: r.clinic_had_mia for r in var.clinic_attributes(control, "asset_tag", t, STUDY).collect()}
    assert got == {"W3": 1, "w1": 1}


def test_network_gap(control, t):
    got = {r.asset_tag: (r.month, r.export_days, r.ntw_days, r.gap_days)
           for r in var.network_gap(control, "asset_tag", t, STUDY).collect()}
    assert got["W3"] == (6, 2, 1, 1)


def test_variable_tables_have_one_row_per_asset(cases, control, t):
    one = var.case_variables(cases, t, STUDY)
    assert tuple(audit(one, "asset_name").first()) == (1, 1)
    assert one.first().software_version == "4.3" and one.first().min_free_space_by_type == 20.0
    many = var.case_variables(cases, t, STUDY, distinct_combinations=True)
    assert tuple(audit(many, "asset_name").first()) == (4, 1)   # two intervals times two hardware rows
    assert tuple(audit(var.control_variables(control, t, STUDY), "asset_name").first()) == (2, 2)
    fan = var.control_variables(control, t, STUDY, distinct_combinations=True).filter("asset_name = 'W3'")
    assert fan.count() == 4                                      # two versions times two free-space values
    assert {r.battery_charge_level for r in fan.collect()} == {2.0}


def test_network_off(cases, t):
    row = act.network_off(cases, "asset_name", t, STUDY).first()
    # 30 November 06:00 UTC is midnight in US/Central: e3 is outside, e2 inside.
    assert (row.months_withissues, row.avg_network_issues) == (1, 2.0)
    assert tuple(act.network_off_summary(cases, "asset_name", t, STUDY).first()) == (1, 11, 11)


def test_ad_activity(cases, t):
    row = act.ad_activity(cases, "asset_name", t, STUDY).first()
    assert row.avg_campaigns == 1.5                              # two in June, one in July
    assert row.JUNE_avg_video_dispalys == 8.0 and row.JUNE_avg_video_duration == 3.5
    assert row.JUL_avg_video_dispalys == 0.0
    folded = act.fold_activity_rows(act.ad_activity_rows(cases, "asset_name", t, STUDY)).first()
    assert folded.asDict() == row.asDict()
    assert sorted(r.name or "" for r in act.brands(cases, "asset_name", t, STUDY).collect()) == ["", "Acme"]


def test_sessions(cases, t):
    row = act.sessions(cases, "asset_name", t, STUDY).first()
    assert row.jun_avg_timeout_sessions == 1.5                  # one on the 2nd, two on the 3rd
    assert row.jun_avg_Crash_sessions == 0.0                    # a null session is not counted
    assert row.nov_avg_exit_sessions == 0.0


def test_touches(cases, t):
    got = act.touches(cases, "asset_name", t, STUDY).collect()
    assert [(r.anatomy_model, r.avg_touches) for r in got] == [("Heart", 1.5)]


def test_wide_table_and_splits(spark, cases, control, t, tmp_path):
    wide = prepare.wide_table(cases, control, t, STUDY)
    assert wide.df.columns[0] == "asset_id" and wide.df.columns[-1] == "y_flag"
    assert {r.asset_id: r.y_flag for r in wide.df.collect()} == {"W1": 1, "W3": 0, "w1": 0}
    assert "Heart" in wide.numerics and "Lung" not in wide.numerics   # Lung was touched by one cohort only
    assert wide.df.select(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in wide.features]).first() == tuple(
        [False] * len(wide.features))
    both = prepare.balanced(wide, STUDY)
    assert both.df.groupBy("y_flag").count().filter("count = 1").count() == 2
    splits = prepare.normalised_splits(wide, STUDY, fit_on="all")
    means = splits.df.select(*[F.avg(f"`{c}`").alias(c) for c in wide.numerics]).first()
    assert all(abs(m) < 1e-9 for m in means)
    prepare.write_splits(splits, str(tmp_path))
    schema = ", ".join(f"`{c}` STRING" for c in wide.df.columns)
    parts = [read_csv(spark, str(tmp_path / p), schema) for p in ("train", "test", "valid")]
    assert sum(p.count() for p in parts) == 3


def test_csv_keeps_quotes_and_nulls(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, None)]
    write_csv(spark.createDataFrame(rows, "i INT, s STRING"), str(tmp_path / "x"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "x"), "i INT, s STRING").collect()) == rows


def test_tables_partition_and_bucket(spark, t):
    from outagelab.sources import write_table

    write_table(t["devices_history"], "history_by_day", partition_by=["export_date"])
    day = spark.table("history_by_day").filter(F.col("export_date") == d(7, 20))
    assert day.count() == 1 and "PartitionFilters: [isnotnull(export_date" in day._jdf.queryExecution().toString()
    for name in ("devices_history", "poweroff_events"):
        write_table(t[name], f"bucketed_{name}", bucket_by="asset_id", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_devices_history").join(spark.table("bucketed_poweroff_events"), "asset_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
