"""Parameters of one cohort study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]

# Months of the study window and the column spelling the result tables use.
MONTHS = (6, 7, 8, 9, 10, 11)
DISPLAY_NAMES = {6: "JUNE_avg_video_dispalys", 7: "JUL_avg_video_dispalys", 8: "AUG_avg_video_dispalys",
                 9: "SEPT_avg_video_dispalys", 10: "OCT_avg_video_dispalys", 11: "NOV_avg_video_dispaly"}
DURATION_NAMES = {6: "JUNE_avg_video_duration", 7: "JUL_avg_video_duration", 8: "AUG_avg_video_duration",
                  9: "SEPT_avg_video_duration", 10: "OCT_avg_video_duration", 11: "NOV_avg_video_duration"}
SESSION_MONTHS = {6: "jun", 7: "jul", 8: "aug", 9: "sept", 10: "oct", 11: "nov"}
SESSION_TYPES = {"Timeout": "timeout", "Crash": "Crash", "Exit": "exit"}
CATEGORICAL = ("software_version", "manufacturer", "model", "sku", "state", "is_battery_charging",
               "facility_type", "ranking", "specialty")


@dataclass(frozen=True)
class Study:
    """Window (both days inclusive for dates), zone of epoch ranges, cap, device type and seed.

    The month columns ignore the year, so the window should lie within one calendar year. ``cap`` bounds the
    control rows of a device type where a capped table is asked for; nothing else is cut by it.
    """

    first: str = "2020-06-01"
    last: str = "2020-11-30"
    zone: str = "US/Central"
    cap: int | None = None
    device_type: str = "WALLBOARD"
    default_days: int = 7
    seed: int = 42
    case_type: str = "MIA"
    power_unit: str = "seconds"
