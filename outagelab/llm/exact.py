"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Each level groups only what the level before left in groups of two or more, so whole texts are hashed only where
length and beginning are shared. What a level shares is told to the next one as a bitmap over ``SLOTS`` slots (a value's
remainder, or its hash): SLOTS / 8 bytes at most, whatever the number of documents, and so broadcast. Two values in one
slot cost a needless hash and nothing else, as only equal whole hashes (256 bits) make a group. Texts are never shuffled;
the last level shuffles (id, hash) rows, counted before the shuffle, so a text that fills a third of the table is one row
per task there.

Cases: a null text counts as empty, and empty texts are equal to each other. The row of the largest id stays; a null id is
the smallest. Of rows that repeat both id and text one stays, any of them. Every row gives one row. An empty table gives no
rows. Columns beyond the two named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import KEY, TEXT

SLOTS = 1 << 26         # of the bitmaps between levels: at most 8 MB, 2,048 rows of 4 KB
PREFIX = 64             # characters of the second level
DIGEST = "__digest"


def _shared(slot: Column, rows: DataFrame) -> DataFrame:
    """Bitmaps, a row for each 32,768 slots, of the slots that two rows or more fall into."""
    twice = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("slot"))
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("__bucket")).agg(bits.alias("__bits"))


def _marked(rows: DataFrame, slot: Column, shared: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a flag: the bit of their slot is set. At most SLOTS / 8 bytes are broadcast."""
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(shared), "__bucket", "left")
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, __place) & 1") == 1
    return found.withColumns({"__byte": byte, "__place": (place % 8).cast("int")}).withColumn(
        flag, F.coalesce(bit, F.lit(False))).drop("__bucket", "__bits", "__byte", "__place")


def survivors(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep`` and the whole text of every row, and ``survives``: its length and its beginning are shared."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(TEXT))
    length = F.octet_length(TEXT)
    by_length = F.pmod(length.cast("long"), F.lit(SLOTS)) + 1
    by_prefix = F.pmod(F.xxhash64(length, F.substring(TEXT, 1, PREFIX)), F.lit(SLOTS)) + 1
    rows = _marked(rows, by_length, _shared(by_length, rows), "__length")
    # a row that left at the first level takes no part in the second
    prefixes = _shared(by_prefix, rows.where("__length"))
    rows = _marked(rows, by_prefix, prefixes, "__prefix")
    return rows.withColumn("survives", F.col("__length") & F.col("__prefix")).drop("__length", "__prefix")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, ``keep_id`` (id of the row that stays), ``group_size`` and ``kept``.

    With ``digests`` also ``text_sha256`` of every row, which then has to be taken of texts that are alone as well.
    """
    rows = survivors(docs, text_col, F.col(id_col).alias(KEY))
    whole = F.sha2(TEXT, 256)
    named = stage(rows.select(
        KEY, "survives", F.when(F.col("survives") | F.lit(digests), whole).alias(DIGEST),
        F.monotonically_increasing_id().alias("__row")), "exact-rows")
    alike = named.where("survives")
    groups = stage(alike.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(KEY, "__row")).alias("__keep"))
                   .where("group_size > 1"), "exact-groups")
    single = named.where(~F.col("survives")).select(
        KEY, F.col(KEY).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), DIGEST)
    grouped = alike.join(groups, DIGEST, "left").select(
        KEY, F.when(F.col("__keep").isNull(), F.col(KEY)).otherwise(F.col("__keep")[KEY]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__keep")["__row"] == F.col("__row"), F.lit(True)).alias("kept"), DIGEST)
    out = single.unionAll(grouped).withColumnRenamed(KEY, id_col)
    return out.withColumnRenamed(DIGEST, "text_sha256") if digests else out.drop(DIGEST)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat id and text any one stays."""
    gone = mark(docs, id_col, text_col, digests=True).where("group_size > 1").select(
        F.col("keep_id").alias("__keep"), F.col("text_sha256").alias(DIGEST)).distinct()
    rows = docs.withColumn(DIGEST, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    stays = rows.join(gone, DIGEST, "left").where(F.col("__keep").eqNullSafe(F.col(id_col)) | F.col("__keep").isNull())
    return stays.dropDuplicates([DIGEST]).drop("__keep", DIGEST)
