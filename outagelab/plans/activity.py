"""Activity variables: network-off events, ad displays, brands, sessions, model touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_day, epoch_range, ms_to_s
from ..functions.windows import epoch_range_ms
from ..operators.activity import month_pivot, month_rows, month_type_pivot, months_with_issues, two_level_avg
from ..operators.joins import cast_key_join, semi_join_keys
from .study import DISPLAY_NAMES, DURATION_NAMES, SESSION_MONTHS, SESSION_TYPES, Study, Tables


def typed_assets(cohort: DataFrame, key: str, study: Study) -> DataFrame:
    """Distinct assets of the cohort whose type contains the studied one, whatever the case."""
    return cohort.filter(F.upper("device_type").like(f"%{study.device_type.upper()}%")).select(
        F.col(key).alias("asset_id")).distinct()


def cohort_events(cohort: DataFrame, key: str, t: Tables, study: Study, name: str) -> DataFrame:
    """Events of one kind in the zone-aware window, for the typed assets of the cohort."""
    rows = t["device_events"].filter(
        epoch_range_ms(F.col("event_start_time"), study.first, study.last, study.zone)
        & F.col("event_name").like(f"%{name}%")
    )
    return semi_join_keys(rows, "asset_id", typed_assets(cohort, key, study)).withColumn(
        "day", epoch_day(ms_to_s(F.col("event_start_time"))))


def network_off(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Months with extended network-off events and mean events in those months, per asset."""
    rows = cohort_events(cohort, key, t, study, "ExtendedNetworkOffEvent")
    return months_with_issues(rows, "asset_id", F.month("day"), "event_id")


def network_off_summary(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Distinct assets with such events, first and last month."""
    rows = cohort_events(cohort, key, t, study, "ExtendedNetworkOffEvent")
    return rows.agg(F.count_distinct("asset_id").alias("assets"),
                    F.min(F.month("day")).cast("bigint").alias("first_month"),
                    F.max(F.month("day")).cast("bigint").alias("last_month"))


def cohort_displays(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Display rows of the typed assets; the device list is cut to the cohort before the join."""
    wanted = semi_join_keys(t["devices"].select("id", "asset_id").distinct(), "asset_id",
                            typed_assets(cohort, key, study))
    rows = t["daily_content_displays"].filter(
        epoch_range(F.col("time"), study.first, study.last, study.zone))
    return cast_key_join(rows, wanted, "device_id", "id")


def _campaigns(shown: DataFrame) -> DataFrame:
    months = shown.withColumn("month", F.month(F.col("day").cast("date")))
    return two_level_avg(months, ["asset_id"], ["month"], {"campaigns": F.count_distinct("campaign_id")})


def _daily(shown: DataFrame) -> DataFrame:
    video = F.col("ad_type").ilike("%In%Stream%")
    banner = F.col("ad_type").ilike("%Banner%")
    days = shown.withColumn("date", epoch_day(F.col("time"))).withColumn("month", F.month("date"))
    return two_level_avg(days, ["asset_id", "month"], ["date"], {
        "video_dispalys": F.sum(F.when(video, F.col("total_displays"))),
        "Banner_dispalys": F.sum(F.when(banner, F.col("total_displays"))),
        "video_duration": F.sum(F.when(video, F.col("total_duration"))),
        "Banner_duration": F.sum(F.when(banner, F.col("total_duration"))),
    })


def _cells():
    return {"avg_video_dispalys": DISPLAY_NAMES, "avg_video_duration": DURATION_NAMES}


def ad_activity(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """One row per asset: mean monthly campaigns and the monthly mean displays and durations."""
    shown = cohort_displays(cohort, key, t, study)
    return _campaigns(shown).join(month_pivot(_daily(shown), "asset_id", "month", _cells()), "asset_id", "left")


def ad_activity_rows(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """The sparse form: one row per asset and month with that month's cells filled."""
    shown = cohort_displays(cohort, key, t, study)
    joined = _campaigns(shown).join(_daily(shown), "asset_id", "left")
    cells = month_rows(joined, "month", _cells())
    return joined.select("asset_id", "avg_campaigns", *[c.alias(n) for n, c in cells.items()]).distinct()


def fold_activity_rows(rows: DataFrame) -> DataFrame:
    """Sparse rows to one row per asset: mean of the campaigns, sum of everything else."""
    rest = [c for c in rows.columns if c not in ("asset_id", "avg_campaigns")]
    return rows.groupBy("asset_id").agg(
        F.avg("avg_campaigns").alias("avg_campaigns"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in rest])


def brands(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Distinct sponsors shown per asset; pairs are deduplicated before the name lookup."""
    shown = cohort_displays(cohort, key, t, study).select("asset_id", "campaign_id").distinct()
    names = t["sponsors"].select("salesforce_campaign_id", "name").distinct()
    return cast_key_join(shown, names, "campaign_id", "salesforce_campaign_id", "left").select(
        "asset_id", "name").distinct()


def monthly_sessions(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Mean daily distinct sessions per asset, month and end type."""
    rows = cohort_events(cohort, key, t, study, "SessionEndEvent").withColumn("month", F.month("day"))
    return two_level_avg(rows, ["asset_id", "month", "session_end_type"], ["day"],
                         {"sessions": F.count_distinct("asset_id", "session_id")})


def session_names() -> dict[tuple[int, str], str]:
    return {(m, kind): f"{short}_avg_{word}_sessions"
            for m, short in SESSION_MONTHS.items() for kind, word in SESSION_TYPES.items()}


def sessions(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """One row per asset with a column per (month, end type); missing cells are zero."""
    return month_type_pivot(monthly_sessions(cohort, key, t, study), "asset_id", "month", "session_end_type",
                            "avg_sessions", session_names())


def touches(cohort: DataFrame, key: str, t: Tables, study: Study) -> DataFrame:
    """Mean daily distinct touches per asset and anatomy model."""
    day_type = t["model_interaction"].schema["event_date"].dataType
    rows = t["model_interaction"].filter(
        # Bounds in the type of the column (days as text sort like days), so that they reach the scan.
        F.col("event_date").between(F.lit(study.first).cast(day_type), F.lit(study.last).cast(day_type))
    ).withColumnRenamed("assetid", "asset_id")
    mine = semi_join_keys(rows, "asset_id", typed_assets(cohort, key, study)).withColumn(
        "date", epoch_day(F.col("time")))
    return two_level_avg(mine, ["asset_id", "anatomy_model"], ["date"],
                         {"touches": F.count_distinct("event_datetime")})


def touch_pivot(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row per asset with a column per anatomy model; missing cells are zero."""
    cells = [F.coalesce(F.avg(F.when(F.col("anatomy_model") == m, F.col("avg_touches"))), F.lit(0.0)).alias(n)
             for m, n in models.items()]
    return rows.groupBy("asset_id").agg(*cells)
