"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class first. Every table hashes a vector to the signs of its products with random hyperplanes; two
vectors that share a signature in any table are compared by their exact cosine. A pair that meets in several tables counts
in the first one only. Buckets are compared in tiles of bounded size, which give counts of links and spanning forests,
never lists of pairs.

Bits and tables follow from the number of vectors: buckets are kept near ``BUCKET`` rows, and as many tables are taken as a
pair right at the threshold needs to be met with probability ``RECALL`` (closer pairs are met more surely).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import join_counted
from .components import connected_components, forest
from .tiles import per_group, shuffle_partitions, tiled

THRESHOLD = 0.9
RECALL = 0.98
BUCKET = 64
BLOCK = 1500
SEED = 3


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def usable(vector: Column) -> Column:
    """Not null, of finite numbers only, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _signed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Class, size, unit vector and the signatures of all tables, one row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            for k0 in range(0, batch.num_rows, 2000):
                part = batch.slice(k0, 2000)
                vectors = part.column(2)
                lens = np.asarray(pa.compute.list_value_length(vectors))
                flat = np.asarray(vectors.flatten(), np.float64)
                first = np.concatenate([[0], np.cumsum(lens)])
                signs = np.empty((len(lens), tables), np.int32)
                for d in np.unique(lens):
                    rows = np.flatnonzero(lens == d)
                    if d not in planes:
                        planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
                    x = flat[first[rows][:, None] + np.arange(d)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    on = (x @ planes[d] > 0).reshape(len(rows), tables, bits)
                    signs[rows] = (on * weights).sum(axis=2)
                n = len(lens)
                offsets = pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(signs.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), vectors, lists],
                                                 names=["id", "copies", "vector", "signs"])

    element = classes.schema["vector"].dataType.simpleString()
    found = classes.mapInArrow(run, f"id long, copies long, vector {element}, signs array<int>")
    return found.select("id", "copies", "vector", "signs", F.posexplode("signs").alias("table", "sign")).withColumn(
        "width", F.size("vector"))


def _compare(threshold: float):
    def compare(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        group = group.combine_chunks()
        block, a, b = (group.column(c).to_numpy() for c in ("block", "tile_a", "tile_b"))
        table = int(group.column("table")[0].as_py())
        width = int(group.column("width")[0].as_py())
        x = np.asarray(group.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, width)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        signs = np.asarray(group.column("signs").combine_chunks().flatten()).reshape(len(x), -1)
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        left = np.flatnonzero(block == a[0])
        right = left if a[0] == b[0] else np.flatnonzero(block == b[0])
        links = np.zeros(len(x), np.int64)
        ii, jj = [], []
        for lo in range(0, len(left), 512):
            part = left[lo:lo + 512]
            i, j = np.nonzero(x[part] @ x[right].T >= threshold)
            i, j = part[i], right[j]
            once = i < j if a[0] == b[0] else np.ones(len(i), bool)
            i, j = i[once], j[once]
            if table and len(i):
                fresh = np.empty(len(i), bool)
                for c in range(0, len(i), 100_000):
                    s = slice(c, c + 100_000)
                    fresh[s] = ~(signs[i[s], :table] == signs[j[s], :table]).any(axis=1)
                i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            p, q = forest(len(x), i, j)
            ii.append(p)
            jj.append(q)
        root = np.arange(len(x))
        p, q = forest(len(x), np.concatenate(ii), np.concatenate(jj))
        root[p] = q
        at = np.flatnonzero(links)
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])],
                                          names=["id", "links", "to"])
    return compare


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per vector row: id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows linked directly, equal vectors included; vectors that are null, empty, zero or hold
    null or non-finite numbers have none and are their own component; vectors of different length never meet. Rows with a
    null id are left out of the comparison (they could not be named) and come back without links. Rows that share an id are
    vectors of their own: each has its own links and component.
    """
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).alias("vector"))
    good = rows.where(F.col("vec").isNotNull() & usable(F.col("vector")))
    members = stage(good.withColumn("twin", F.xxhash64("vector")), "vectors")
    # Classes go by numbers of their own, as rows may share a name.
    classes = stage(members.groupBy("twin", "vector").agg(F.min("vec").alias("name"), F.count(F.lit(1)).alias("copies"))
                    .select(F.monotonically_increasing_id().alias("id"), "copies", "vector", "name"), "vector-classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signed = _signed(classes.drop("name"), bits, tables, seed)
    bucket = ["table", "sign", "width"]
    # A vector alone in its bucket has nobody to be compared with; blocks of large buckets are dealt by id.
    tiles = tiled(signed, bucket, "id", block)
    found = stage(per_group(tiles, [*bucket, "tile_a", "tile_b"], _compare(threshold), "id long, links long, to long",
                            shuffle_partitions(vectors)), "vector-links")
    roots = connected_components(found, "id", "to").withColumnRenamed("node", "id")
    least = roots.join(classes.select("id", "name"), "id").groupBy("root").agg(
        F.min("name").alias("least"), F.count(F.lit(1)).alias("n"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "id", "left").join(join_counted(roots, least, ["root"]).drop("root"), "id", "left").select(
        "vector", F.xxhash64("vector").alias("twin"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least", "name").alias("component_id"))
    linked = members.join(named, ["twin", "vector"]).select("vec", "n_links", "component_id")
    alone = rows.where(~(F.col("vec").isNotNull() & usable(F.col("vector")))).select(
        "vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("vec").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec") == F.col("component_id"), F.lit(True)).alias("kept"))
