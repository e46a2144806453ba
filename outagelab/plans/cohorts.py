"""Case and control cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import case_date_filter, recode_system_type
from ..operators.cohort import cap_per_type, coverage
from ..operators.joins import anti_join_keys, next_day_folded_join
from .study import Study, Tables


def _day(text: str):
    return F.lit(text).cast("date")


def case_cohort(t: Tables, study: Study) -> DataFrame:
    """Cases of the wanted type opened since the window start, with their next-day asset state.

    Open cases count, and there is no upper bound on the opening date. The type filter runs
    before the joins, so only matching cases are shuffled.
    """
    reasons = t["case_reason_codes"].filter(F.upper("case_asset_type") == study.case_type)
    items = t["case_assets"].filter(
        (F.coalesce("closed_date", _day(study.last)) >= F.col("created_date"))
        & (F.col("created_date") >= _day(study.first))
    ).select(F.col("case").alias("case_id"), "asset_name", F.col("id").alias("case_asset_id"),
             "resolution", "created_date", "closed_date")
    cases = t["cases"].select("case_id", F.col("created_date").alias("case_opened"), F.col("cmh_id").alias("clinic"))
    anchored = reasons.join(items, ["case_id", "asset_name"]).join(cases, "case_id", "left")
    # The state wanted is that of the day after opening: bounds of those days prune the largest table.
    days = anchored.select(F.to_date("case_opened").alias("day"))
    first, last = (days.agg(F.date_add(f("day"), 1)).scalar() for f in (F.min, F.max))
    state = t["assets_history"].filter(F.col("export_date").between(first, last)).select("asset_tag", "export_date", F.col("status").alias("ams_status"), "ams_id",
                                       "source_system", "source_system_id")
    with_state = next_day_folded_join(anchored, state, "asset_name", "asset_tag", "case_opened", "export_date")
    devices = t["devices"].select(F.col("id").alias("device_id"), "client_id")
    return with_state.join(
        devices,
        (F.upper(with_state["source_system"]) == "MDM") & (devices["device_id"] == with_state["source_system_id"]),
        "left",
    ).select("case_id", "asset_name", "device_type", "reason_code", "case_asset_id", "resolution",
             "created_date", "closed_date", "client_id", "ams_status", "ams_id", F.col("clinic").alias("cmh_id"))


def control_cohort(t: Tables, study: Study, fold_case: bool = False) -> DataFrame:
    """Installed assets of the window that never had a case of the wanted type."""
    ever = t["case_reason_codes"].filter(F.upper("case_asset_type") == study.case_type)
    installed = t["assets_history"].filter(
        (F.upper("status") == "INSTALLED")
        & F.col("export_date").between(_day(study.first), _day(study.last))
    ).select("ams_id", "asset_tag", "cmh_id", "source_system", "source_system_id").distinct()
    clean = anti_join_keys(installed, "asset_tag", ever, "asset_name", fold_case)
    devices = t["devices"].select(F.col("id").alias("device_id"), "client_id", "type")
    return clean.join(
        devices,
        (F.upper(clean["source_system"]) == "MDM") & (devices["device_id"] == clean["source_system_id"]),
        "left",
    ).select("ams_id", "asset_tag", "client_id", "cmh_id",
             recode_system_type("type").alias("device_type")).distinct()


def capped_control(control: DataFrame, study: Study) -> DataFrame:
    """At most ``study.cap`` control rows per device type, in tag order, with their rank ``rn``."""
    if study.cap is None:
        raise ValueError("the study names no cap")
    return cap_per_type(control, "device_type", "asset_tag", study.cap)


def type_coverage(cases: DataFrame, t: Tables, case_types, history_types) -> DataFrame:
    """Case assets of some named types that the device history knows under some system types."""
    named = cases.filter(F.col("device_type").isin(*case_types)).select(F.col("asset_name").alias("asset_id"))
    known = t["devices_history"].filter(F.col("type").isin(*history_types)).select("asset_id")
    return coverage(named.distinct(), known.distinct())


def clinic_had_case(t: Tables, study: Study) -> DataFrame:
    """Clinics with at least one case in the window, one row per clinic."""
    reasons = t["case_reason_codes"].filter(F.upper("case_asset_type") == study.case_type).select(
        "case_id", "asset_name")
    items = t["case_assets"].filter(
        case_date_filter(F.col("created_date"), study.first, study.last)
    ).select(F.col("case").alias("case_id"), "asset_name")
    clinics = t["cases"].filter(F.col("cmh_id").isNotNull()).select("case_id", "cmh_id")
    return reasons.join(items, ["case_id", "asset_name"]).join(clinics, "case_id").select("cmh_id").distinct()
