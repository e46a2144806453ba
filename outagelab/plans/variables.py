"""Device variables: software, hardware, power-off, clinic; and the tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import case_date_filter, first_integer, reconcile_days, recode_display_name, \
    recode_system_type, whole_days
from ..operators.activity import event_frequency, gap_days, min_per_type
from ..operators.features import long_attributes
from ..operators.joins import attach_small, case_intervals, latest_in_interval, latest_per_key, semi_join_keys
from .cohorts import clinic_had_case
from .study import Study, Tables

SOFTWARE = ("software_version", "free_disk_space", "is_battery_charging", "battery_charge_level")
HARDWARE = ("manufacturer", "model", "sku", "processor", "screen_size")
CLINIC = ("state", "facility_type", "ranking", "account_type", "specialty", "business_tier")


def _in_window(study: Study):
    return F.col("export_date").between(F.lit(study.first).cast("date"), F.lit(study.last).cast("date"))


def case_windows(cases: DataFrame, study: Study) -> DataFrame:
    """Interval of every distinct case of an asset: previous close to this open."""
    distinct = cases.select(
        "asset_name", recode_display_name("device_type").alias("device_type"), "created_date", "closed_date"
    ).distinct()
    return case_intervals(distinct, ["asset_name"], "created_date", "closed_date",
                          order=["created_date", "closed_date", "device_type"], default_days=study.default_days)


def _latest_distinct(found: DataFrame, time: str, payload, keep_time: bool = False) -> DataFrame:
    """Latest row per (asset, interval start), as one aggregate.

    Intervals without a snapshot of an asset share one empty row.
    """
    start = F.when(F.col(time).isNotNull(), F.col("start_date"))
    best = F.max(F.struct(time, *payload, "device_type", "end_date")).alias("_b")
    rows = found.groupBy("asset_name", start.alias("_start")).agg(best)
    cols = ["asset_name", "_b.device_type", *[f"_b.{c}" for c in payload]]
    return rows.select(*cols, "_b.end_date") if keep_time else rows.select(*cols).distinct()


def software_history(t: Tables) -> DataFrame:
    return t["devices_history"].select(
        F.col("asset_id").alias("asset_name"), "type", "export_date",
        F.col("device_apk_version").alias("software_version"), "free_disk_space", "is_battery_charging",
        "battery_charge_level",
    )


def _since_first_interval(history: DataFrame, study: Study) -> DataFrame:
    """No interval starts earlier than ``default_days`` before the window: prune the scan."""
    return history.filter(
        F.col("export_date") >= F.date_sub(F.lit(study.first).cast("date"), study.default_days)
    )


def case_software(cases: DataFrame, t: Tables, study: Study, keep_time: bool = False) -> DataFrame:
    """Software state at the latest snapshot inside each case interval."""
    history = _since_first_interval(software_history(t), study)
    found = latest_in_interval(case_windows(cases, study), history, ["asset_name"], "start_date", "end_date",
                               "export_date", SOFTWARE)
    return _latest_distinct(found, "export_date", SOFTWARE, keep_time)


def case_hardware(cases: DataFrame, t: Tables, study: Study, keep_time: bool = False) -> DataFrame:
    """Hardware attributes, kept when the SKU was exported inside the case interval.

    The attributes sit on the asset and the dates on the SKU, so the lookup runs per SKU: the
    table of (asset, export date) pairs is never built.
    """
    windows = case_windows(cases, study)
    owned = windows.join(t["assets"].withColumnRenamed("asset_tag", "asset_name"), "asset_name", "left")
    exports = _since_first_interval(t["sku_history"], study).select(F.col("sku_code").alias("sku"), "export_date")
    found = latest_in_interval(owned, exports, ["sku"], "start_date", "end_date", "export_date", [])
    seen = F.col("export_date").isNotNull()
    guarded = found.withColumns({c: F.when(seen, F.col(c)) for c in HARDWARE})
    # An asset with several SKUs: the interval counts as matched when any of them was exported.
    per_interval = guarded.groupBy("asset_name", "device_type", "created_date", "closed_date",
                                   "start_date", "end_date").agg(
        F.max(F.struct("export_date", *HARDWARE)).alias("_h")
    ).select("asset_name", "device_type", "start_date", "end_date", "_h.*")
    return _latest_distinct(per_interval, "export_date", HARDWARE, keep_time)


def min_free_space(t: Tables) -> DataFrame:
    return min_per_type(t["devices_history"], recode_system_type("type"), "free_disk_space",
                        "min_free_space_by_type")


def power_off(t: Tables, study: Study, end_inclusive_day: bool = False) -> DataFrame:
    """Per asset: distinct power-off starts and the mean of the positive day counts.

    The default keeps the plain timestamp comparison, which ends at midnight of the last day.
    """
    rows = t["poweroff_events"].filter(
        case_date_filter(F.col("event_start"), study.first, study.last, end_inclusive_day)
    ).distinct()
    days = reconcile_days(whole_days(F.col("estimated_power_off_minutes"), study.power_unit),
                          first_integer(F.col("message")))
    return event_frequency(rows, "asset_id", "event_start", days)


def clinic_attributes(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Clinic attributes per asset and whether the clinic had a case in the window."""
    accounts = t["accounts"].select(
        "cmh_id", F.col("billing_state_province").alias("state"), "facility_type", "ranking", "account_type",
        F.col("lead_category").alias("specialty"), "business_tier",
    )
    flagged = clinic_had_case(t, study).withColumn("_hit", F.lit(1))
    return (
        cohort.select(F.col(key).alias("asset_name"), "cmh_id").distinct()
        .join(accounts, "cmh_id", "left").join(flagged, "cmh_id", "left")
        .select("asset_name", "cmh_id", *CLINIC, F.coalesce("_hit", F.lit(0)).alias("clinic_had_mia"))
        .distinct()
    )


def network_gap(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Export days, pinged days and their difference per cohort asset and month."""
    history = semi_join_keys(
        t["assets_history"].filter(_in_window(study)).select("asset_tag", "export_date", "last_pinged_at"),
        "asset_tag", cohort, key,
    )
    return gap_days(history, "asset_tag", F.col("export_date"), F.to_date("last_pinged_at"))


def control_history(control: DataFrame, t: Tables, study: Study) -> DataFrame:
    """History rows of the control assets in the window: the one read behind all their variables."""
    rows = t["devices_history"].filter(_in_window(study)).select(
        F.col("asset_id").alias("asset_name"), "export_date", "is_battery_charging", "battery_charge_level",
        F.col("device_apk_version").alias("software_version"), "free_disk_space")
    return semi_join_keys(rows, "asset_name", control, "asset_tag")


def _named_version():
    version = F.col("software_version")
    return F.when(version.isNotNull() & ~version.like("%nil%"), version)


def _control_anchor(control: DataFrame) -> DataFrame:
    return control.groupBy(F.col("asset_tag").alias("asset_name")).agg(F.min("device_type").alias("device_type"))


def control_latest(control: DataFrame, t: Tables, study: Study, history: DataFrame | None = None) -> DataFrame:
    """Latest battery state of each control asset in the window."""
    history = control_history(control, t, study) if history is None else history
    latest = latest_per_key(history, ["asset_name"], "export_date", ["is_battery_charging", "battery_charge_level"])
    return _control_anchor(control).join(latest.drop("export_date"), "asset_name", "left")


def control_versions(history: DataFrame) -> DataFrame:
    """Distinct known software versions per asset of a narrowed history."""
    return history.select("asset_name", _named_version().alias("software_version")).filter(
        "software_version is not null").distinct()


def control_free_space(history: DataFrame) -> DataFrame:
    """Distinct positive free-space values per asset of a narrowed history."""
    return history.filter(F.col("free_disk_space") > 0).select("asset_name", "free_disk_space").distinct()


def control_state(control: DataFrame, t: Tables, study: Study) -> DataFrame:
    """Per control asset the latest battery state, greatest version and greatest free space, in one pass."""
    found = control_history(control, t, study).groupBy("asset_name").agg(
        F.max(F.struct("export_date", "is_battery_charging", "battery_charge_level")).alias("_b"),
        F.max(_named_version()).alias("software_version"),
        F.max(F.when(F.col("free_disk_space") > 0, F.col("free_disk_space"))).alias("free_disk_space"))
    return _control_anchor(control).join(found, "asset_name", "left").select(
        "asset_name", "device_type", "_b.is_battery_charging", "_b.battery_charge_level", "software_version",
        "free_disk_space")


def control_hardware(control: DataFrame, t: Tables, study: Study) -> DataFrame:
    """Hardware attributes of control assets whose SKU was exported in the window."""
    exported = t["sku_history"].filter(_in_window(study)).select(F.col("sku_code").alias("sku")).distinct()
    assets = t["assets"].withColumnRenamed("asset_tag", "asset_name").join(exported, "sku", "left_semi")
    return control.select(F.col("asset_tag").alias("asset_name")).distinct().join(
        assets.select("asset_name", *HARDWARE).distinct(), "asset_name", "left")


def _assemble(software: DataFrame, hardware: DataFrame, cohort: DataFrame, key: str, t: Tables,
              study: Study) -> DataFrame:
    clinic = clinic_attributes(cohort, key, t, study).drop("cmh_id")
    power = power_off(t, study).withColumnRenamed("asset_id", "asset_name")
    return (
        attach_small(software, min_free_space(t), ["device_type"])
        .join(hardware.select("asset_name", *HARDWARE).distinct(), "asset_name", "left")
        .join(power, "asset_name", "left").join(clinic, "asset_name", "left")
        .select("asset_name", "device_type", *SOFTWARE, "min_free_space_by_type", *HARDWARE,
                "avg_times", "avg_days", *CLINIC, "clinic_had_mia")
    )


def _one_row(df: DataFrame, cols, latest: str) -> DataFrame:
    """Row of the latest interval per asset."""
    return df.groupBy("asset_name").agg(F.max(F.struct(latest, *cols)).alias("_b")).select("asset_name", "_b.*")


def _one_clinic(cohort: DataFrame, key: str) -> DataFrame:
    return cohort.groupBy(key).agg(F.max("cmh_id").alias("cmh_id"))


def case_variables(cases: DataFrame, t: Tables, study: Study, distinct_combinations: bool = False) -> DataFrame:
    """Variable table of the case cohort.

    Default: one row per asset, from its latest case interval. ``distinct_combinations=True``
    gives one row per distinct combination of interval, hardware and clinic, as the study's
    table had it; :func:`case_attributes` feeds the encoders without building it.
    """
    software = case_software(cases, t, study, keep_time=not distinct_combinations)
    hardware = case_hardware(cases, t, study, keep_time=not distinct_combinations)
    if distinct_combinations:
        return _assemble(software, hardware, cases, "asset_name", t, study).distinct()
    software = _one_row(software, ["device_type", *SOFTWARE], "end_date")
    hardware = _one_row(hardware, HARDWARE, "end_date")
    return _assemble(software, hardware, _one_clinic(cases, "asset_name"), "asset_name", t, study)


def control_variables(control: DataFrame, t: Tables, study: Study, distinct_combinations: bool = False) -> DataFrame:
    """Variable table of the control cohort.

    Default: one row per asset with its greatest version and free space of the window. The
    study's table held every version with every free-space value of an asset;
    ``distinct_combinations=True`` reproduces that, :func:`control_attributes` avoids it.
    """
    hardware = control_hardware(control, t, study)
    if distinct_combinations:
        history = control_history(control, t, study)
        software = control_latest(control, t, study, history).join(
            control_versions(history), "asset_name", "left").join(control_free_space(history), "asset_name", "left")
        return _assemble(software, hardware, control, "asset_tag", t, study).distinct()
    hardware = hardware.groupBy("asset_name").agg(F.max(F.struct(*HARDWARE)).alias("_h")).select("asset_name", "_h.*")
    return _assemble(control_state(control, t, study), hardware, _one_clinic(control, "asset_tag"), "asset_tag", t, study)


def case_attributes(cases: DataFrame, t: Tables, study: Study, software: DataFrame | None = None) -> DataFrame:
    """Distinct (asset, variable, value) rows of the case cohort, from the separate blocks.

    ``software`` may be the stored result of :func:`case_software`.
    """
    known = case_software(cases, t, study) if software is None else semi_join_keys(software, "asset_name", cases)
    blocks = [
        long_attributes(known, "asset_name", ["software_version", "is_battery_charging"]),
        long_attributes(case_hardware(cases, t, study), "asset_name", ["manufacturer", "model", "sku"]),
        long_attributes(clinic_attributes(cases, "asset_name", t, study), "asset_name",
                        ["state", "facility_type", "ranking", "specialty"]),
    ]
    return blocks[0].unionByName(blocks[1]).unionByName(blocks[2])


def control_attributes(control: DataFrame, t: Tables, study: Study, base: DataFrame | None = None,
                       history: DataFrame | None = None) -> DataFrame:
    """Distinct (asset, variable, value) rows of the control cohort; versions stay in long form.

    ``base`` may be the stored result of :func:`control_latest`, ``history`` that of :func:`control_history`.
    """
    history = control_history(control, t, study) if history is None else history
    base = control_latest(control, t, study, history) if base is None else base
    versions = base.select("asset_name").join(control_versions(history), "asset_name", "left")
    blocks = [
        long_attributes(versions, "asset_name", ["software_version"]),
        long_attributes(base, "asset_name", ["is_battery_charging"]),
        long_attributes(control_hardware(control, t, study), "asset_name", ["manufacturer", "model", "sku"]),
        long_attributes(clinic_attributes(control, "asset_tag", t, study), "asset_name",
                        ["state", "facility_type", "ranking", "specialty"]),
    ]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out
