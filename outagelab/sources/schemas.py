"""Fixed schemas of the base tables a study reads (only the columns in use)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Table and column names of the study's source systems.
SCHEMAS: dict[str, str] = {
    "case_reason_codes": "case_id STRING, asset_name STRING, device_type STRING, reason_code STRING, "
                         "case_asset_type STRING",
    "case_assets": "id STRING, `case` STRING, asset_name STRING, resolution STRING, created_date DATE, "
                   "closed_date DATE",
    "cases": "case_id STRING, created_date TIMESTAMP, cmh_id STRING",
    "assets_history": "ams_id STRING, asset_tag STRING, status STRING, source_system STRING, "
                      "source_system_id STRING, export_date DATE, cmh_id STRING, last_pinged_at TIMESTAMP",
    "assets": "asset_tag STRING, sku STRING, manufacturer STRING, model STRING, processor STRING, "
              "screen_size STRING",
    "devices": "id STRING, client_id STRING, asset_id STRING, type STRING",
    "devices_history": "asset_id STRING, type STRING, export_date DATE, device_apk_version STRING, "
                       "free_disk_space DOUBLE, is_battery_charging BOOLEAN, battery_charge_level DOUBLE",
    "sku_history": "sku_code STRING, export_date DATE",
    "poweroff_events": "asset_id STRING, event_start TIMESTAMP, event_end TIMESTAMP, message STRING, "
                       "estimated_power_off_minutes BIGINT",
    "accounts": "cmh_id STRING, billing_state_province STRING, facility_type STRING, ranking DOUBLE, "
                "account_type STRING, lead_category STRING, business_tier STRING",
    "device_events": "asset_id STRING, event_id STRING, event_name STRING, event_start_time BIGINT, "
                     "session_id STRING, session_end_type STRING",
    "daily_content_displays": "device_id BIGINT, time BIGINT, day STRING, campaign_id STRING, "
                              "ad_type STRING, total_displays BIGINT, total_duration DOUBLE",
    "sponsors": "salesforce_campaign_id STRING, name STRING",
    "model_interaction": "assetid STRING, anatomy_model STRING, time BIGINT, event_datetime TIMESTAMP, "
                         "event_date STRING",
}


def struct_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project a frame onto a base-table schema with explicit casts."""
    return df.selectExpr(*[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in struct_of(table)])
