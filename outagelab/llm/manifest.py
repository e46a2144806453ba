"""Merkle manifest of a table: one digest per row, per group and for the whole, with proofs and their verification.

Every row is a leaf. The leaves of a group, in order of id, are a tree of ``arity``; the roots of the groups, in order of
the group, are one more tree. A level is built by a self-join: each node of slot zero asks for its siblings by their
computed indices (its own plus the slot offsets), the equijoin of nodes on (tree, index) answers, and the slot-zero row
emits the parent with the digests of its run. Going down again, a node's path is the part of its run left and right of it
in front of its parent's path.

Scale: nodes are 32-byte digests, written level by level, an ``arity``-th of the rows each; the number of levels is the
logarithm of the largest tree, which is the only number the driver sees. Places within a tree come from a range sort
(``ordered``), so a group that holds a third of all rows is no task of its own. Texts are read once and never shuffled. A
path meets its leaf in the last join and ends in its hash there.

Cases: a null value is hashed as ``-``, which no other value is. A null group is a group of its own, the first. Within a
group a null id comes first, and rows of equal id follow their leaves' order; rows that are equal throughout have equal
leaves and different places. A group of one row is its own root; a table of one group has the root of that group. An empty
table gives no rows. Columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import ascii_lower
from .ordered import in_order, positions

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")   # what a leaf hashes, in this order
NODE = ("tree", "idx", "size", "digest")


def joined_digest(parts: Column) -> Column:
    """H of several texts: SHA-256, in lowercase hex, of their concatenation."""
    return F.sha2(F.array_join(parts, ""), 256)


def field(value: Column) -> Column:
    """Byte count, colon and value in UTF-8; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return joined_digest(F.array(*map(field, values)))


def tree_key(group: Column) -> Column:
    """A group as text that is never null and orders like it: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def parents(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """The level above: (tree, idx, size, digest) and ``children``, the digests of the run from left to right."""
    asked = nodes.where(F.col("idx") % arity == 0).select(
        "tree", "size", F.expr(f"idx div {arity}").alias("parent"), "idx",
        F.explode(F.sequence(F.lit(0), F.lit(arity - 1))).alias("offset"),
    ).withColumn("idx", F.col("idx") + F.col("offset")).where("idx < size")
    met = asked.join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
    run = F.transform(F.array_sort(F.collect_list(F.struct("offset", "digest"))), lambda x: x["digest"])
    size = F.expr(f"(max(size) + {arity - 1}) div {arity}")
    return met.groupBy("tree", F.col("parent").alias("idx")).agg(size.alias("size"), run.alias("children")).select(
        "tree", "idx", "size", joined_digest(F.col("children")).alias("digest"), "children")


def climb(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels over ``leaves``; a tree ends at the level where its size is 1. Driver work: one number."""
    levels = [leaves]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        levels.append(stage(parents(levels[-1].where("size > 1").select(*NODE), arity), "manifest-level"))
        largest = -(-largest // arity)
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    tops = [level.where("size = 1").select("tree", "digest") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def paths(levels: Sequence[DataFrame], at_roots: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``, an array of (left, right) texts from the leaf up, and the columns of ``at_roots``.

    ``at_roots`` has a row per tree with the path above its root.
    """
    extra = [c for c in at_roots.columns if c not in ("tree", "path")]
    above = None
    for level in reversed(levels):
        here = level.where("size = 1").join(at_roots, "tree")
        if above is not None:
            slot = F.col("idx") % arity
            step = F.struct(F.array_join(F.slice("run", F.lit(1), slot.cast("int")), "").alias("left"),
                            F.array_join(F.slice("run", (slot + 2).cast("int"), F.lit(arity)), "").alias("right"))
            up = above.select("tree", F.col("idx").alias("up"), F.col("children").alias("run"), F.col("path").alias("rest"), *extra)
            inner = level.where("size > 1").withColumn("up", F.expr(f"idx div {arity}")).join(up, ["tree", "up"])
            here = here.unionByName(inner.select(*level.columns, F.concat(F.array(step), "rest").alias("path"), *extra))
        above = here
    return above


@dataclass(frozen=True)
class Manifest:
    """Levels of the groups' trees and of the tree over their roots; ``leaves`` also has id and the columns asked for."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    arity: int = ARITY

    @property
    def subroots(self) -> DataFrame:
        """(tree, subroot)"""
        return roots(self.levels).withColumnRenamed("digest", "subroot")

    @property
    def root(self) -> DataFrame:
        """One row: (root); none for an empty table."""
        return roots(self.top).select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """The leaves with ``path``, ``subroot`` and ``root``."""
        over_all = roots(self.top).select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                                          F.col("digest").alias("root"))
        above = paths(self.top, over_all, self.arity)
        at_roots = above.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path", "root")
        return paths([self.leaves, *self.levels[1:]], at_roots, self.arity)


def build(rows: DataFrame, group: Column, order: Column, digest: Column, arity: int = ARITY, **keep: Column) -> Manifest:
    """Manifest of ``rows``: a tree per ``group`` over leaves in ``order``; ``keep`` names columns that stay beside them."""
    named = stage(rows.select(tree_key(group).alias("tree"), order.alias("place"), digest.alias("digest"),
                              *[c.alias(k) for k, c in keep.items()]), "manifest-leaves")
    leaves = stage(positions(in_order(named, ["tree"], ["place", "digest"], "manifest-order"), ["tree"], "idx", "size"),
                   "manifest-placed")
    levels = climb(leaves, arity)
    subroots = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = stage(positions(in_order(stage(subroots, "manifest-subroots"), ["tree"], ["name"], "manifest-tops"), ["tree"], "idx", "size"),
                "manifest-top")
    return Manifest(leaves, levels, climb(top, arity), arity)


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf_digest, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """H of all siblings from left to right, level by level upwards."""
    return joined_digest(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def tampered_proofs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang",
                    fields: Sequence[str] = FIELDS, every: int = 3) -> DataFrame:
    """Proofs of all rows and what they say once the text of a third of the rows, by a checksum of the id, is lower-cased.

    A row whose text has no capital letter, or is null, is not changed by it and still verifies.
    """
    changed = {**{c: F.col(c) for c in fields}, text_col: ascii_lower(F.col(text_col))}
    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0) & F.col(text_col).isNotNull()
    tree = build(docs, F.col(group_col), F.col(id_col), leaf([F.col(c) for c in fields]), id=F.col(id_col),
                 tampered=F.when(hit, leaf([changed[c] for c in fields])))
    folded = tree.proofs().withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
    return folded.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
