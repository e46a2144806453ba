"""Prefix trie of conversations with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Its identity is the depth and 128 bits summed over its turns, each turn
hashed with its place (MD5 of role and text, then two 64-bit hashes with the place), so prefixes come from running totals:
a conversation that holds a third of all turns is split over many tasks (``ordered``).

Totals flow from the leaves to the root:

* Chains. Nodes with the same members are one chain: they share the smallest member and the number of members, and the
  chain is a stretch of that member's turns. A chain needs one record, whatever its length; sums along it are differences of
  running totals.
* Shards. Chains are classed by the bits of their number of members, ``LIGHT`` bits a class. A shard root is a chain
  without ancestor in its class; what hangs below it in the class is processed in one partition, and each partition takes
  many. Class by class, what the roots of a class hand up goes to the next one as messages, summed before they move.
* Within a partition chains come in reverse level order, sorted by Spark (which spills), and every chain takes the
  totals its children have sent out of a priority queue over (level, chain), adds its own and sends the sum to its parent.
  The queue keeps ``QUEUE`` messages in memory and the rest in sorted runs on disk, private to the task and repeated with it.

Lists of members that end at a node are hashed as a stream: pieces of 256 ids from a sorted table, so a group of copies of
any size needs no list in memory.

Cases: rows without a conversation belong to none and are left out. Null role or text is empty. Equal turn numbers keep the
order of their hashes; a repeated row is a turn of its own. A conversation without turns is a member of the root. Texts are
read whole, once. An empty table gives no rows. Columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from tempfile import TemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import SPACES, words
from .ordered import ROW, in_order, positions, running

LIGHT = 8               # bits of the number of members in a class: a factor of 256
QUEUE = 200_000         # messages of a queue in memory
FAN = 32                # sorted runs that a queue reads side by side
PIECE_BITS = 8          # ids in a piece of a list of members, as a power of two
NODE = ("d", "k1", "k2")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- conversations as sequences of hashed turns

@dataclass(frozen=True)
class Sequences:
    """``turns`` (conv, pos from 0, mark, words) and ``convs`` (conv, length)."""

    turns: DataFrame
    convs: DataFrame


def sequences(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Sequences:
    """Conversations in order of turn, null first."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    mark = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)))
    narrow = stage(rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), mark.alias("mark"),
        F.size(words(what, SPACES)).cast("long").alias("words")), "trie-turns")
    turns = stage(positions(in_order(narrow, ["conv"], ["turn", "mark"], "trie-order"), ["conv"], "pos", "length"), "trie-places")
    return Sequences(turns.select("conv", "pos", "mark", "words"), turns.where("pos = 0").select("conv", "length"))


def rebuilt(given: Sequences, every: int = 20, most: int = 4) -> Sequences:
    """Every conversation c with its first h turns replaced by those of conversation c - c % every.

    h is a checksum of c modulo ``most``. A shorter conversation in that place lends all its turns, an absent one none.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = given.convs.select("conv", "length", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    lender = given.convs.select(F.col("conv").alias("base"), F.col("length").alias("has"))
    convs = stage(convs.join(lender, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent"),
        F.greatest(F.col("length") - F.col("h"), F.lit(0)).alias("own")), "trie-rebuilt")
    first = given.turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    lent = convs.join(first, "base").where("pos < lent").select("conv", "pos", "mark", "words")
    rest = given.turns.join(convs, "conv").where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "mark", "words")
    return Sequences(lent.unionByName(rest), convs.select("conv", (F.col("lent") + F.col("own")).alias("length")))


# --- time-forward processing inside a partition

class SpillingQueue:
    """Priority queue of (key..., payload...) tuples of integers; beyond ``limit`` of them sorted runs go to disk."""

    def __init__(self, keys: int, width: int, limit: int = QUEUE):
        self.keys, self.limit = keys, limit
        self.record = struct.Struct(f"<{width}q")
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._write(iter(sorted(self.heap)))
            self.heap = []
            if len(self.runs) > FAN:
                runs, self.runs = self.runs, []
                self._write(heapq.merge(*[self._whole(r) for r in runs]))

    @staticmethod
    def _whole(run: tuple) -> Iterator[tuple]:
        yield run[0]
        yield from run[2]

    def _write(self, items: Iterator[tuple]) -> None:
        file = TemporaryFile()
        for item in items:
            file.write(self.record.pack(*item))
        file.seek(0)
        self.spilled += 1
        self._add(self.spilled, self._read(file))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while chunk := file.read(self.record.size * 4096):
                yield from self.record.iter_unpack(chunk)

    def _add(self, number: int, items: Iterator[tuple]) -> None:
        if (head := next(items, None)) is not None:
            heapq.heappush(self.runs, (head, number, items))

    def take(self, key: tuple) -> Iterator[tuple]:
        """Remove the messages of ``key``, which must be the least one that is left."""
        while True:
            spilled = bool(self.runs) and (not self.heap or self.runs[0][0] < self.heap[0])
            head = self.runs[0][0] if spilled else self.heap[0] if self.heap else None
            if head is None or head[:self.keys] != key:
                return
            if spilled:
                _, number, items = heapq.heappop(self.runs)
                self._add(number, items)
            else:
                heapq.heappop(self.heap)
            yield head[self.keys:]

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


CHAIN = ("conv", "n", "top", "up_conv", "up_n", "up_top", "inside", "saved", "got_leaves", "got_saved", "got_children")
TOTALS = "conv long, n long, up_conv long, up_n long, inside boolean, leaves long, saved long, children long, below long"


def forward(batches: Iterator[pd.DataFrame], limit: int = QUEUE) -> Iterator[pd.DataFrame]:
    """Totals of chains that come in reverse level order: (top descending, conv, n)."""
    queue = SpillingQueue(3, 5, limit)
    for batch in batches:
        out = []
        for conv, n, top, up_conv, up_n, up_top, inside, saved, leaves, below, children in batch[list(CHAIN)].itertuples(
                index=False, name=None):
            for more_leaves, more_saved in queue.take((-top, conv, n)):
                leaves, below, children = leaves + more_leaves, below + more_saved, children + 1
            leaves = leaves or 1
            if inside:
                queue.push((-up_top, up_conv, up_n, leaves, saved + below))
            out.append((conv, n, up_conv, up_n, inside, leaves, saved + below, children, below))
        yield pd.DataFrame(out, columns=["conv", "n", "up_conv", "up_n", "inside", "leaves", "saved", "children", "below"])
    assert not len(queue), "a message was sent to a chain outside its shard"


# --- the trie

def _prefixes(given: Sequences) -> DataFrame:
    """(conv, d, k1, k2, p1, p2, words, length, sum_words): a row per conversation and turn, with the node and its parent."""
    low = F.lit(0xFFFFFFFF)
    a, b = F.xxhash64("pos", "mark"), F.xxhash64("mark", F.lit("place"), "pos")
    halves = {f"s{2 * i + j}": v for i, x in enumerate((a, b))
              for j, v in enumerate((F.shiftrightunsigned(x, 32), x.bitwiseAND(low)))}
    rows = given.turns.select("conv", (F.col("pos") + 1).alias("d"), "words", F.col("words").alias("sum_words"),
                              *[v.alias(k) for k, v in halves.items()], *[v.alias(k.replace("s", "t")) for k, v in halves.items()])
    sums = running(in_order(stage(rows, "trie-marks"), ["conv"], ["d"], "trie-depths"), ["conv"], [*halves, "sum_words"])

    def packed(i: int, less: bool) -> Column:
        high, rest = ((F.col(f"s{2 * i + j}") - F.col(f"t{2 * i + j}") * F.lit(int(less))).bitwiseAND(low) for j in (0, 1))
        return F.shiftleft(high, 32).bitwiseOR(rest)

    keyed = sums.select("conv", "d", packed(0, False).alias("k1"), packed(1, False).alias("k2"), packed(0, True).alias("p1"),
                        packed(1, True).alias("p2"), "words", "sum_words")
    return stage(keyed.join(given.convs, "conv"), "trie-prefixes")


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, k1, k2, ends_sha256) of every node at which conversations end; ids ascending, comma-joined, hashed as a stream."""
    zero = F.lit(0).cast("long")
    at = prefixes.where("d = length").select(*NODE, "conv").unionByName(
        convs.where("length = 0").select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "conv"))
    ids = in_order(stage(at, "trie-ends"), list(NODE), ["conv"], "trie-ends-sorted")
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ids.groupBy(*NODE, F.shiftright(ROW, PIECE_BITS).alias("place")).agg(piece.alias("piece"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            done = []
            for d, k1, k2, text in batch[[*NODE, "piece"]].itertuples(index=False, name=None):
                if (d, k1, k2) == node:
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (d, k1, k2), hashlib.sha256()
                digest.update(text.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "place").mapInPandas(
        hashed, "d long, k1 long, k2 long, ends_sha256 string")


def _class(n: Column, light: int) -> Column:
    return F.expr("0") if light <= 0 else F.floor((F.length(F.bin(n)) - 1) / light).cast("int")


def _chains(nodes: DataFrame) -> DataFrame:
    """One row per chain: (conv, n), its depths, the nodes at its ends, and its own saving."""
    ends = nodes.groupBy("conv", "n").agg(
        F.min_by(F.struct("d", "p1", "p2", "words", "sum_words"), "d").alias("first"),
        F.max_by(F.struct("d", "k1", "k2", "sum_words"), "d").alias("last"))
    along = F.col("last.sum_words") - F.col("first.sum_words") + F.col("first.words")
    return ends.select("conv", "n", F.col("first.d").alias("top"), F.col("first.p1").alias("p1"), F.col("first.p2").alias("p2"),
                       "last.*", ((F.col("n") - 1) * along).alias("saved")).withColumnsRenamed({"d": "bottom", "sum_words": "sum_bottom"})


def _shards(prefixes: DataFrame, nodes: DataFrame, light: int) -> DataFrame:
    """(conv, class, shard): the topmost node of each class along each conversation."""
    seen = prefixes.select("conv", *NODE).join(nodes.select(*NODE, _class(F.col("n"), light).alias("class")), list(NODE))
    return seen.groupBy("conv", "class").agg(F.min_by(F.struct(*NODE), "d").alias("shard"))


def prefix_trie(given: Sequences, light: int = LIGHT, limit: int = QUEUE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = _prefixes(given)
    zero = F.lit(0).cast("long")
    root = given.convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).where("n > 0").select(
        *[zero.alias(c) for c in (*NODE, "p1", "p2")], "n", "conv", zero.alias("words"), zero.alias("sum_words"))
    below = prefixes.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"),
        *[F.min(c).alias(c) for c in ("p1", "p2", "words", "sum_words")])
    nodes = stage(below.unionByName(root), "trie-nodes")
    top_class = nodes.where("d = 0").select(_class(F.col("n"), light)).first()
    top_class = top_class[0] if top_class else 0

    chains = stage(_chains(nodes), "trie-chains")
    uppers = nodes.select((F.col("d") + 1).alias("top"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                          F.col("conv").alias("up_conv"), F.col("n").alias("up_n"))
    linked = chains.where("top > 0").join(uppers, ["top", "p1", "p2"])
    tops = chains.select(F.col("conv").alias("up_conv"), F.col("n").alias("up_n"), F.col("top").alias("up_top"))
    linked = linked.join(tops, ["up_conv", "up_n"]).unionByName(chains.where("top = 0"), allowMissingColumns=True)
    kind = _class(F.col("n"), light)
    top_shard = F.struct(*[zero.alias(c) for c in NODE])
    placed = linked.withColumn("class", kind).join(_shards(prefixes, nodes, light), ["conv", "class"], "left")
    placed = stage(placed.select(
        "conv", "n", "top", "bottom", "sum_bottom", "k1", "k2", "saved", "up_conv", "up_n", "up_top", "class",
        F.when(F.col("class") == top_class, top_shard).otherwise(F.col("shard")).alias("shard"),
        F.coalesce(_class(F.col("up_n"), light) == F.col("class"), F.lit(False)).alias("inside")), "trie-placed")

    done: list[DataFrame] = []
    for step in range(top_class + 1):
        mine = placed.where(F.col("class") == step)
        if done:
            sent = done[0]
            for part in done[1:]:
                sent = sent.unionByName(part)
            # a chain of a lower class hands its totals to a parent of this one
            sent = sent.where(~F.col("inside")).groupBy(F.col("up_conv").alias("conv"), F.col("up_n").alias("n")).agg(
                F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"), F.count(F.lit(1)).alias("got_children"))
            mine = mine.join(sent, ["conv", "n"], "left")
        else:
            mine = mine.withColumns({c: F.lit(None).cast("long") for c in CHAIN[-3:]})
        ready = mine.fillna(0, ["got_leaves", "got_saved", "got_children", "up_conv", "up_n", "up_top"])
        ordered = ready.repartition("shard").select(*CHAIN).sortWithinPartitions(F.desc("top"), "conv", "n")
        done.append(stage(ordered.mapInPandas(lambda batches: forward(batches, limit), TOTALS), f"trie-class-{step}"))
    totals = done[0]
    for part in done[1:]:
        totals = totals.unionByName(part)
    ends = _ends(prefixes, given.convs).withColumnRenamed("d", "bottom")
    finished = placed.join(totals.select("conv", "n", "leaves", "children", "below"), ["conv", "n"]).join(
        ends, ["bottom", "k1", "k2"], "left")
    finished = stage(finished.select("conv", "n", "top", "bottom", "sum_bottom", "up_conv", "leaves", "children", "below",
                                     F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends")), "trie-totals")
    last = F.col("d") == F.col("bottom")
    return nodes.join(finished, ["conv", "n"]).select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.when(F.col("d") == F.col("top"), F.col("up_conv")).otherwise(F.col("conv"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("sum_bottom") - F.col("sum_words") + F.col("words"))).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
