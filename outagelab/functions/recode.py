"""Device-type recodes and missing-value sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names as they appear in the source systems.
TV_NAMES = ("TV Screen", "Waiting Room Screen")
TABLET_NAMES = ("UnregisteredTablet", "Tablet")
INFUSION_NAME_PATTERN = "%Infusion Room Tablet%"
PLAYER_TYPES = ("AndroidMediaPlayer", "LinuxMediaPlayer")
INFUSION_TYPES = ("InfusionRoomTablet",)
UNKNOWN = "unknown"
VERSION_VALUES = ("[APK NOT INSTALLED]", "nil", "None", "NOT INSTALLED")
FACILITY_VALUES = ("Other",)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_display_name(c: str | Column) -> Column:
    """Case-side device names to one device type."""
    c = _col(c)
    return (
        F.when(c.isin(*TV_NAMES), "WRTV")
        .when(c.isin(*TABLET_NAMES), "TABLET")
        .when(c.like(INFUSION_NAME_PATTERN), "IRT")
        .otherwise(F.upper(c))
    )


def recode_system_type(c: str | Column) -> Column:
    """Device-registry types to the same device types."""
    c = _col(c)
    return (
        F.when(c.isin(*PLAYER_TYPES), "WRTV")
        .when(c.isin(*INFUSION_TYPES), "IRT")
        .when(c.isin(*TABLET_NAMES), "TABLET")
        .otherwise(F.upper(c))
    )


def clean_sentinels(c: str | Column, sentinels=VERSION_VALUES) -> Column:
    """Null and every sentinel become ``unknown``; one list serves both cohorts."""
    c = _col(c)
    return F.when(c.isNull() | c.isin(*sentinels), UNKNOWN).otherwise(c)


def fill_unknown(df: DataFrame, cols) -> DataFrame:
    """Null becomes ``unknown`` in every listed column, whatever its type."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN)) for c in cols})


def null_if_unknown(c: str | Column) -> Column:
    c = _col(c)
    return F.when(c != UNKNOWN, c)
