"""Comparison of the rows of a bucket with each other, in tiles of bounded size.

A bucket of any size is cut into blocks, and every pair of blocks is one tile, so no task ever holds a whole hot bucket
and no pair of rows is written out. Ordinary buckets are one block and one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, bucket: list[str], spread: str, limit: int) -> DataFrame:
    """The rows with their tile: ``tile_a`` <= ``tile_b`` number the two blocks, ``block`` is the row's own.

    ``spread`` is a column whose hash deals the rows of a large bucket to blocks. Rows of a bucket with n blocks are
    repeated n times, in blocks of about ``limit`` rows.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("bucket_rows"))
    sized = rows.join(sizes.where(F.col("bucket_rows") > limit), bucket, "left")
    blocks = F.ceil(F.coalesce(F.col("bucket_rows"), F.lit(1)) / limit).cast("int")
    dealt = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (other.withColumn("tile_a", F.least("block", "other")).withColumn("tile_b", F.greatest("block", "other"))
            .drop("blocks", "other", "bucket_rows"))


def per_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str,
              partitions: int) -> DataFrame:
    """Apply ``work`` to the rows of each key; keys are dealt to partitions and met in sorted order, one at a time."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]
            change = [0]
            if batch.num_rows > 1:
                differs = cols[0][1:] != cols[0][:-1]
                for c in cols[1:]:
                    differs |= c[1:] != c[:-1]
                change += (differs.nonzero()[0] + 1).tolist()
            change.append(batch.num_rows)
            for lo, hi in zip(change, change[1:]):
                key = tuple(c[lo] for c in cols)
                if held and key != last:
                    out = work(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
