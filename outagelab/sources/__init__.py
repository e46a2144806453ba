"""Table schemas, readers, sinks and audits."""

from .readers import load_tables, read_csv, read_jdbc, read_parquet, read_stage
from .schemas import SCHEMAS, conform
from .sinks import audit, stage, stage_all, write_csv, write_stage, write_table

__all__ = [
    "SCHEMAS", "audit", "conform", "load_tables", "read_csv", "read_jdbc", "read_parquet",
    "read_stage", "stage", "stage_all", "write_csv", "write_stage", "write_table",
]
