"""SimHash near-dedup with vantage-point trees.

Fingerprints are computed from hashed word shingles. Distinct fingerprints are partitioned by their Hamming distances to a
few vantage points: equal distance vectors are one shard. By the triangle inequality a fingerprint within r bits has
distances that differ by at most r, and all of them by the parity of the distance between the two; so a shard is compared
with itself and with the few shards those bounds leave. Within a shard a vantage-point tree prunes the same way down to
leaves, which are compared exactly. Copies of a fingerprint are one class, links within a shard leave it as a spanning
forest, and components join the classes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import discard, stage
from .common import KEY, document_key, keyed
from .components import connected_components, forest
from .tiles import per_group, shuffle_partitions

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SAMPLE = 1024      # fingerprints from which vantage points are chosen
SHARD = 200        # fingerprints a shard should hold
RINGS = 14         # shards that a vantage point makes of random fingerprints: 2 x sqrt(pi) x standard deviation 4
BLOCK = 20_000     # rows of a shard compared at a time by one task
LEAF = 512
BASE = 72          # digits of a packed distance vector: 0..64, with room for the offsets


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingle hashes have it; 0 without words."""
    ws = (text or "").encode().lower().split()  # bytes: lowers A-Z alone and splits at ASCII white space
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    n = max(len(ws) - shingle + 1, 1)
    stops = ends[shingle - 1:].tolist() if len(ws) >= shingle else [len(line)]
    starts = [0] + (ends[:n - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):  # bounded memory for very long texts
        part = hashes[lo:lo + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Key and fingerprint (as a signed long) of every row; null and wordless texts have fingerprint 0."""
    source = keyed(docs, id_col, text_col)
    kind = source.schema[KEY].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[KEY, "print"])

    return source.mapInArrow(run, f"{KEY} {kind}, print long")


def _vantage_points(sample: np.ndarray, m: int, seed: int = 7) -> list[int]:
    """m sampled fingerprints whose distances spread most and repeat each other least."""
    chosen: list[int] = []
    if not len(sample):
        return chosen
    pool = np.random.default_rng(seed).permutation(sample)[:64]
    dist = np.bitwise_count(pool[:, None] ^ sample[None, :]).astype(np.float64)
    dist -= dist.mean(axis=1, keepdims=True)
    for _ in range(m):
        best = int(np.argmax((dist ** 2).sum(axis=1)))
        if (dist[best] ** 2).sum() < 1e-9:
            break
        chosen.append(int(pool[best].view(np.int64)))
        axis = dist[best] / np.linalg.norm(dist[best])
        dist = dist - (dist @ axis)[:, None] * axis[None, :]
    return chosen


def _offsets(m: int, r: int) -> list[int]:
    """Packed differences of distance vectors that two fingerprints within r bits can have, one of each +- pair, 0 first."""
    kept = []
    for d in itertools.product(range(-r, r + 1), repeat=m):
        if d < (0,) * m or len({x & 1 for x in d}) > 1:
            continue
        kept.append(sum(x * BASE ** k for k, x in enumerate(reversed(d))))
    return sorted(kept)


def _near(home: np.ndarray, guest: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within r bits, by a vantage-point tree over ``home``."""
    todo = [(np.arange(len(home)), np.arange(len(guest)))]
    while todo:
        h, g = todo.pop()
        if not len(h) or not len(g):
            continue
        if len(h) > LEAF:
            point = home[h[len(h) // 2]]
            dh = np.bitwise_count(home[h] ^ point).astype(np.int16)
            radius = int(np.median(dh))
            inside = dh <= radius
            if 0 < inside.sum() < len(h):
                dg = np.bitwise_count(guest[g] ^ point).astype(np.int16)
                todo.append((h[inside], g[dg <= radius + r]))
                todo.append((h[~inside], g[dg >= radius + 1 - r]))
                continue
        step = max(1, (1 << 20) // len(h))
        for lo in range(0, len(g), step):
            part = g[lo:lo + step]
            x, y = np.nonzero(np.bitwise_count(home[h][:, None] ^ guest[part][None, :]) <= r)
            if len(x):
                yield h[x], part[y]


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``max_bits`` bits of each other.

    ``prints`` has one row per distinct fingerprint. Whatever two of them are that close are connected by links, though
    not each pair by a link of its own.
    """
    n = prints.count()
    # A bounded sample, only to choose the points: any points give the same links.
    sample = prints.orderBy(F.xxhash64(F.lit(1), "print")).limit(SAMPLE).collect()
    m = max(1, min(5, math.ceil(math.log(max(n, 2) / SHARD, RINGS)))) if n > SHARD else 1
    points = _vantage_points(np.array([r[0] for r in sample], np.int64).view(np.uint64), m)
    shard = F.lit(0).cast("long")
    for p in points:
        shard = shard * BASE + F.bit_count(F.col("print").bitwiseXOR(F.lit(p))).cast("long") + max_bits
    offsets = _offsets(len(points), max_bits)
    homes = prints.select(shard.alias("shard"), "print")
    # Visits to another shard meet its residents only; residents meet each other and all visitors.
    visits = homes.select("shard", "print", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])).alias("o")).where(
        "o != 0").select((F.col("shard") + F.col("o")).alias("shard"), "print")
    rows = homes.withColumn("home", F.lit(True)).unionByName(visits.withColumn("home", F.lit(False)))
    tiles = _shard_tiles(rows)

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        p = group.column("print").to_numpy().view(np.uint64)
        role = group.column("role").to_numpy()
        home, guest = p[role != 1], p[role != 0]
        if not len(home) or not len(guest):
            return None
        nodes, at = np.unique(np.concatenate([home, guest]), return_inverse=True)
        hi, gi = at[:len(home)], at[len(home):]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for x, y in _near(home, guest, max_bits):
            a, b = hi[x], gi[y]
            found.append((a[a != b], b[a != b]))
            held += len(x)
            if held > 4_000_000:  # a dense shard: keep only what connects
                found = [forest(len(nodes), *map(np.concatenate, zip(*found)))]
                held = 0
        if not found:
            return None
        a, b = forest(len(nodes), *map(np.concatenate, zip(*found)))
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(nodes[a].view(np.int64)), pa.array(nodes[b].view(np.int64))],
                                          names=["a", "b"])

    return per_group(tiles, ["shard", "part_home", "part_guest"], compare, "a long, b long", shuffle_partitions(prints))


def _shard_tiles(rows: DataFrame) -> DataFrame:
    """Deal the rows of large shards to (home block, guest block) tiles; ``role``: 0 home, 1 guest, 2 both."""
    sizes = rows.groupBy("shard").agg(F.count_if("home").alias("residents"), F.count(F.lit(1)).alias("guests"))
    big = sizes.where((F.col("residents") > BLOCK) | (F.col("guests") > 4 * BLOCK)).select(
        "shard", F.ceil(F.col("residents") / BLOCK).cast("int").alias("homes"),
        F.ceil(F.col("guests") / (4 * BLOCK)).cast("int").alias("parts"))
    dealt = rows.join(big, "shard", "left")
    split = F.col("homes").isNotNull()
    plain = F.array(F.struct(F.lit(0).alias("part_home"), F.lit(0).alias("part_guest"),
                             F.when(F.col("home"), F.lit(2)).otherwise(F.lit(1)).alias("role")))
    own_home = F.pmod(F.xxhash64(F.lit(2), "print"), F.col("homes")).cast("int")
    own_part = F.pmod(F.xxhash64(F.lit(3), "print"), F.col("parts")).cast("int")
    as_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
        own_home.alias("part_home"), p.alias("part_guest"), F.lit(0).alias("role")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: F.struct(
        h.alias("part_home"), own_part.alias("part_guest"), F.lit(1).alias("role")))
    cells = F.when(~split, plain).when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)
    return dealt.select("shard", "print", F.explode(cells).alias("c")).select(
        "shard", "c.part_home", "c.part_guest", "print", "c.role")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document row: id, ``text_hash``, ``fingerprint`` (16 hex digits), ``component_id`` and ``root``.

    The component is the least id that is reachable by fingerprints within ``max_bits`` bits (null if it has null ids
    only); ``root`` is its least fingerprint. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = stage(prints.groupBy("print").agg(F.min(F.col(KEY)["id"]).alias("least")), "simhash-classes")
    roots = connected_components(near_links(classes.select("print"), max_bits))
    rooted = stage(classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")), "simhash-roots")
    discard(classes)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("print", "component", "root")
    return prints.join(named, "print").select(
        F.col(KEY)["id"].alias(id_col), F.col(KEY)["hash"].alias("text_hash"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"), "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns: the least id (nulls last); repeated rows of it once."""
    found = groups(docs, id_col, text_col, **options)
    order = F.struct(F.col(id_col).isNull().alias("n"), F.struct(
        F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).alias(KEY))
    first = found.groupBy("root").agg(F.min(order).alias("k")).select(f"k.{KEY}")
    kept = docs.withColumn(KEY, document_key(id_col, text_col)).join(first, KEY, "left_semi")
    return kept.dropDuplicates([KEY]).drop(KEY)
