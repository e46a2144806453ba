"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Each line hash gets a HyperLogLog sketch of the sites it stands on;
sketches merge by aggregation, on the map side first. Lines whose estimate is clearly below or above the limit are decided by
it; lines near the limit are counted exactly. Boilerplate lines are then removed wherever they stand.

Scale: lines travel as 128-bit hashes. Lines of a single site (least site hash = greatest site hash) need no sketch and are
set aside by a plain aggregate. A very common line is one row per map task in every aggregate, and joins to it are against
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import KEY, document_key

MIN_SITES = 5
LG_K = 12          # 4096 registers: a relative error of 1.6 per cent
NEAR = 0.25        # estimates within this share of the limit are counted exactly
BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_key(line: Column) -> Column:
    """Identity of a line without its outer white space; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The line keys of ``lines`` (``line``, ``site``: hash of the site) that stand on at least ``min_sites`` sites."""
    several = lines.groupBy("line").agg(F.min("site").alias("low"), F.max("site").alias("high")).where(
        "low <> high" if min_sites > 1 else F.lit(True)).select("line")
    spread = lines.join(several, "line")
    sketched = stage(spread.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select(
        "line", F.hll_sketch_estimate("sketch").alias("estimate")), "line-spread")
    near = F.abs(F.col("estimate") - min_sites) <= F.greatest(F.lit(1.0), F.lit(NEAR * min_sites))
    exact = (lines.join(sketched.where(near).select("line"), "line").select("line", "site").distinct()
             .groupBy("line").count().where(F.col("count") >= min_sites).select("line"))
    return sketched.where(~near & (F.col("estimate") >= min_sites)).select("line").unionByName(exact)


def find_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """Per document (key, ``n_lines`` that are not blank) and, for documents with boilerplate, (key, ``lines``)."""
    hashed = stage(docs.select(
        document_key(id_col, text_col).alias(KEY), F.xxhash64(site_col).alias("site"),
        F.filter(F.transform(_lines(F.col(text_col)), _line_key), lambda k: k.isNotNull()).alias("lines")), "line-hashes")
    each = hashed.select("site", F.explode("lines").alias("line"))
    found = stage(boilerplate(each, min_sites), "line-boilerplate")
    hits = hashed.select(KEY, F.explode(F.array_distinct("lines")).alias("line")).join(found, "line").groupBy(KEY).agg(
        F.collect_set("line").alias("boilerplate"))
    return hashed.select(KEY, F.size("lines").cast("long").alias("n_lines")), hits


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with all their columns, boilerplate lines cut out, and ``n_lines``, ``n_removed`` beside them.

    Lines are compared without outer white space; blank lines are neither counted nor removed; the other lines keep their
    text and order. A null text has no lines and stays null; a null site is a site of its own; a document that is all
    boilerplate becomes an empty text. Existing columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    _, hits = find_boilerplate(docs, id_col, text_col, site_col, min_sites)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*keep).withColumn(KEY, document_key(id_col, text_col)).join(
        hits.withColumnRenamed("boilerplate", "__hit"), KEY, "left")
    lines = F.transform(_lines(F.col(text_col)), lambda x: F.struct(x.alias("text"), _line_key(x).alias("key")))
    known = F.col("__hit").isNotNull()
    gone = lambda x: F.coalesce(F.array_contains(F.col("__hit"), x["key"]), F.lit(False))
    out = joined.withColumn("__lines", lines).withColumn("__kept", F.filter("__lines", lambda x: ~gone(x)))
    text = F.when(known, F.array_join(F.transform("__kept", lambda x: x["text"]), "\n")).otherwise(F.col(text_col))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in keep],
        F.size(F.filter("__lines", lambda x: x["key"].isNotNull())).cast("long").alias("n_lines"),
        F.when(known, F.size("__lines") - F.size("__kept")).otherwise(F.lit(0)).cast("long").alias("n_removed"))


def digest(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_removed", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256"))
