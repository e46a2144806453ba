"""Sinks and the row / key audit that follows every build."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, root: str, name: str, partition_by=(), compression: str | None = None) -> DataFrame:
    """Rebuild one stage as parquet and return it read back, which also cuts its lineage."""
    path = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, else a folder in the warehouse.

    Both are reachable from every executor; the rule is the same for every master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate table once and go on from the written files.

    Several later steps read it, and a lost executor costs a read instead of a recomputation.
    Its file size also lets the optimizer choose joins.
    """
    return write_stage(df, stage_root(df.sparkSession), f"{name}-{uuid.uuid4().hex}", compression=compression)


def drop_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*stages: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in stages:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def stage_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """Stage independent tables side by side, so that one's tail does not idle the cluster."""
    spark = next(iter(frames.values())).sparkSession

    @inheritable_thread_target(spark)
    def run(item):
        return item[0], stage(item[1], item[0])

    with ThreadPool(len(frames)) as pool:
        return dict(pool.map(run, frames.items()))


def write_table(df: DataFrame, table: str, partition_by=(), bucket_by=None, buckets: int = 0) -> None:
    """Rebuild a catalog table; bucket history tables on the asset to join without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Files are one per partition, never one for the whole table."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def audit(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of a table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(key)).alias("n_keys"),
    )
