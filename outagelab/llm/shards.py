"""Sharding by minimax contiguous partition.

Rows with equal texts are one atomic group. Groups are ordered by a hash of their text, and the order is cut into
contiguous shards so that the largest shard is as small as any contiguous cut can make it: the least feasible capacity is
found by binary search, each capacity checked by filling shards greedily.

Scale: the sizes of all groups never meet in one place. A trie over the hash (FAN nodes a level) gives prefix sums at its
node borders; greedy filling with a node taken as indivisible gives an upper bound of the capacity, with a node taken as
freely divisible a lower bound. Only the few nodes in which fills end are refined, a level at a time, until the bounds
meet; then the cuts are exact. Slots are prefix sums over hash buckets, so neither a shard nor a group is one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import KEY, document_key

SHARDS = 16
LEVEL_BITS = (12, 24, 36, 48, 64)   # prefixes of the hash that are the levels of the trie
BUCKETS = 1024
NEARBY = 32


@dataclass(frozen=True)
class Node:
    first: int    # least hash of the node
    level: int
    size: int
    groups: int


class Trie:
    """Sizes of ordered groups, known at the borders of nodes that are refined on demand. Holds O(shards x FAN) nodes."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes = self._read(0, None)
        self._sum_up()

    def _prefix(self, level: int) -> Column:
        return F.shiftright("key", 64 - LEVEL_BITS[level])

    def _read(self, level: int, within: list[int] | None) -> list[Node]:
        rows = self.groups
        if within is not None:
            rows = rows.where(self._prefix(level - 1).isin(within))
        got = rows.groupBy(self._prefix(level).alias("p")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups")).collect()
        return [Node(r["p"] << (64 - LEVEL_BITS[level]), level, r["size"], r["groups"]) for r in got]

    def _sum_up(self) -> None:
        self.nodes.sort(key=lambda n: n.first)
        self.sums = [0]
        for n in self.nodes:
            self.sums.append(self.sums[-1] + n.size)

    @property
    def total(self) -> int:
        return self.sums[-1]

    def divisible(self, k: int) -> bool:
        return k < len(self.nodes) and self.nodes[k].groups > 1

    def refine(self, which: set[int]) -> None:
        """Replace nodes by their children, one query for each level among them."""
        split = [self.nodes[k] for k in which]
        kept = [n for k, n in enumerate(self.nodes) if k not in which]
        for level in sorted({n.level for n in split}):
            within = [n.first >> (64 - LEVEL_BITS[level]) for n in split if n.level == level]
            kept += self._read(level + 1, within)
        self.nodes = kept
        self._sum_up()

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[int]]:
        """Whether greedy shards of this capacity hold everything, and the nodes in which they end."""
        at, ends = 0, []
        for _ in range(shards):
            k = bisect_right(self.sums, at + capacity) - 1
            ends.append(k)
            at = at + capacity if hopeful and self.divisible(k) else self.sums[k]
        return at >= self.total, ends

    def least_capacity(self, shards: int, hopeful: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[0]:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_capacity(trie: Trie, shards: int) -> int:
    """The least capacity that greedy contiguous shards need, exactly."""
    while True:
        low, high = trie.least_capacity(shards, True), trie.least_capacity(shards, False)
        if low == high:
            return low
        first, last = trie.fill(low, shards, True)[1], trie.fill(high, shards, False)[1]
        open_nodes = {k for k in first + last if trie.divisible(k)}
        for a, b in zip(first, last):
            if abs(b - a) <= NEARBY:
                open_nodes |= {k for k in range(min(a, b), max(a, b) + 1) if trie.divisible(k)}
        trie.refine(open_nodes)


def balanced_cuts(trie: Trie, shards: int, capacity: int) -> list[int]:
    """Borders (hashes) of the shards: each as near to its even place as the capacity lets it be."""
    while True:
        open_nodes: set[int] = set()
        sums, total = trie.sums, trie.total

        def border(x: float, up: bool) -> int:
            """The nearest known border at or beyond x; notes the node that hides a nearer one."""
            k = bisect_left(sums, x) if up else bisect_right(sums, x) - 1
            inside = k - 1 if up else k
            if sums[min(k, len(sums) - 1)] != x and 0 <= inside and trie.divisible(inside):
                open_nodes.add(inside)
            return sums[min(k, len(sums) - 1)]

        least = [0] * shards + [total]
        for j in range(shards - 1, 0, -1):
            least[j] = border(max(least[j + 1] - capacity, 0), True)
        cuts, at = [], 0
        for j in range(1, shards):
            ideal = total * j / shards
            under, over = border(ideal, False), border(ideal, True)
            near = under if ideal - under <= over - ideal else over
            at = min(max(near, least[j], at), border(at + capacity, False))
            cuts.append(at)
        if not open_nodes:
            ends = [bisect_left(sums, c) for c in cuts]
            return [trie.nodes[k].first for k in ends if k < len(trie.nodes)]
        trie.refine(open_nodes)


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document row: id, ``size``, ``text_crc32``, ``shard`` from 0 and ``slot``, gapless from 0 per shard.

    Equal texts share a shard, all null texts too (a null text has the CRC of no bytes, 0). With fewer groups than shards
    some shards stay empty; an empty table gives an empty result. Repeated rows have slots of their own.
    """
    rows = stage(docs.select(
        document_key(id_col, text_col).alias(KEY), text_size(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32")), "shard-rows")
    groups = stage(rows.groupBy(F.col(KEY)["hash"].alias("key")).agg(F.sum("size").alias("size")), "shard-groups")
    trie = Trie(groups)
    cuts = balanced_cuts(trie, shards, minimax_capacity(trie, shards)) if trie.total else []
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col(KEY)["hash"] >= F.lit(cut)).cast("int")
    placed = rows.withColumn("shard", number).withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("first", F.sum("n").over(
        W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(KEY))
    return placed.join(first, ["shard", "bucket"]).select(
        F.col(KEY)["id"].alias(id_col), "size", "text_crc32", "shard", (F.col("first") + inside - 1).cast("long").alias("slot"))


def assignments(sharded: DataFrame) -> DataFrame:
    """Digest of :func:`shard` under the law of near equal bytes; this law has no placement for one more shard."""
    first = sharded.columns[0]
    return sharded.select(first, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
