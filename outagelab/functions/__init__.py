"""Column expressions: recodes, sentinels, epoch windows, durations and shares."""

from .durations import first_integer, reconcile_days, whole_days
from .recode import (
    FACILITY_VALUES,
    UNKNOWN,
    VERSION_VALUES,
    clean_sentinels,
    fill_unknown,
    null_if_unknown,
    recode_display_name,
    recode_system_type,
)
from .shares import importance_share, percent, rate, rounded
from .windows import case_date_filter, epoch_day, epoch_range, ms_to_s, zone_bounds

__all__ = [
    "FACILITY_VALUES", "UNKNOWN", "VERSION_VALUES", "case_date_filter", "clean_sentinels", "epoch_day", "epoch_range", "fill_unknown",
    "first_integer", "importance_share", "ms_to_s", "null_if_unknown", "percent", "rate",
    "reconcile_days", "recode_display_name", "recode_system_type", "rounded", "whole_days",
    "zone_bounds",
]
