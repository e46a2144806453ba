"""Readers. All of them return lazy frames; projection and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS, struct_of


def read_parquet(spark: SparkSession, path: str, columns=None, where=None) -> DataFrame:
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema: inference would read the data twice.

    ``NaN``-free fields only; an empty field is null. Quotes inside a field are doubled, as
    :func:`outagelab.sources.write_csv` writes them.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("escape", '"').option("multiLine", False)
        .csv(path)
    )


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 1, **options) -> DataFrame:
    """Warehouse query to frame. Give a numeric partition column for a parallel read."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    lo, hi = bounds
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", lo).option("upperBound", hi).option("numPartitions", partitions)
        .load()
    )


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, root: str, names=None) -> dict[str, DataFrame]:
    """Base tables stored as ``root/<name>`` parquet, read with their fixed schemas."""
    return {
        n: spark.read.schema(struct_of(n)).parquet(f"{root.rstrip('/')}/{n}")
        for n in (names or SCHEMAS)
    }
