"""Expressions shared by the corpus operators.

Conventions of all operators that decide about documents: a document is a row identified by its id and its text, so
repeated rows count once where results are per document; a null id is an id like any other; columns beyond those
named in the arguments are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import stage, stage_root

# Fixed values of the word rules.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_ALPHANUMERIC_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"

HOT = 4096  # keys with more than this part of all rows are joined apart

# Columns that operators add beside the user's; the prefix keeps them apart from any real name.
KEY, TEXT = "__key", "__text"


def let(value: Column, body) -> Column:
    """Bind an array or other costly value once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; the quick path serves texts of single-byte characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separator: str) -> Column:
    """Non-empty parts between separators; an empty array for null and for texts without words."""
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    return F.filter(parts, lambda w: w != "")


def document_key(id_col: str, text_col: str) -> Column:
    """Identity of a document: its id (null is an id like any other) and a hash of its text. Equal keys meet in joins."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key and text, free of the other columns and their names."""
    return docs.select(document_key(id_col, text_col).alias(KEY), F.col(text_col).alias(TEXT))


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of stored ``rows`` with a table of one row per key, whose ``n`` says how many of ``rows`` have the key at least.

    Rows of hot keys stay where they are and meet a broadcast of their keys; the rest is joined by key, so no task gets more
    than a small share of the rows for one key. A key is hot beyond a ``HOT``-th of all rows that ``counted`` counts, hence
    at most ``HOT`` keys are broadcast, whatever the size of the input. ``how`` is inner or left; null keys match nothing.
    """
    hot = counted.where(F.col("n") > F.lit(counted.agg(F.sum("n")).first()[0] or 0) / HOT).drop("n")
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(counted.drop("n"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of each execution at its end, not when the driver's collector finds them unused.

    Meant for writes, whose shuffles nothing reads again. (Where Spark is older than the setting, the collector does it.)
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a stage, without the shuffles that led to it."""
    with shuffles_dropped(df.sparkSession):
        return stage(df, name, compression)


def bucketed_stage(df: DataFrame, name: str, by: str) -> tuple[DataFrame, str]:
    """``df`` as a stage in buckets of a column, one for each shuffle partition, and the name of its table.

    Joins by that column shuffle the other side only. The files are in the folder of all stages; the table is theirs in the
    catalog, for the caller to drop.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        df.write.format("parquet").option("path", f"{stage_root(spark)}/{table}").bucketBy(buckets, by).saveAsTable(table)
    return spark.table(table), table


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now, after a stage has been written.

    The cleaner acts when the driver's collector finds a shuffle unused, which on a large heap can take very long.
    """
    spark.sparkContext._jvm.System.gc()
