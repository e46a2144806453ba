"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are laid out in a seeded random order as one sequence of words. A source's target is its quota of
words, taken from the front of that sequence (a second round starts at the front again), so documents stay whole but for the
one in which the quota ends. A quota is cut into tickets, blocks of ``BLOCK`` words, by one rule at every size. The tree
halves the set of output shards again and again: at each node the tickets of all sources are divided by a draw without
replacement (a multivariate hypergeometric draw), down to exact numbers per shard. A shard gets a run of tickets of each
source's random order, hence disjoint blocks, and the documents that begin in them; a hash orders them locally.

Scale: targets and the tree work on one row per source. Where a document lies in its source is a prefix sum in two steps
over hash buckets, so a source with most of the rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .common import KEY, SPACES, TEXT, document_key, words

WEIGHTS = (3, 1, 2)   # by rank of the source, repeating
SHARE = 1.5           # of all words
MOST = 2.0            # times a source's words
BLOCK = 256           # words of a ticket
BUCKETS = 1024
SHARDS = 16
SEED = 11
SPREAD = 8            # standard deviations of a draw that are looked at


def word_count(text: Column) -> Column:
    return F.size(words(text, SPACES)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source from (``source``, ``size``) rows with one row per source.

    Sources are ranked by code point, null last. Shares in proportion to weight fill up like vessels: who reaches ``most``
    times its size stops, the rest goes to the others by weight.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    full = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", most * F.col("size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (share * F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return full.withColumn("level", level).withColumn(
        "target", F.least("cap", F.max("level").over(everything) * F.col("weight"))).drop("level")


def _tickets(targets: DataFrame, block: int) -> DataFrame:
    """The quota of each source, in whole words, and its number of tickets."""
    quota = F.least(F.round("target").cast("long"), F.floor("cap"))
    return targets.withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("quota") / block).cast("long"))


def _draw(population: str, marked: str, draws: str, uniform: str) -> str:
    """SQL of one hypergeometric draw: how many of ``marked`` are among ``draws`` out of ``population``.

    Probabilities follow from each other by ratios, starting at the mode; outcomes are visited outwards from it, until the
    uniform number is used up. ``SPREAD`` standard deviations either way are visited.
    """
    return f"""
    transform(array(named_struct('n', cast({population} as double), 'k', cast({marked} as double),
                                 'd', cast({draws} as double), 'u', {uniform})), q ->
    transform(array(named_struct('q', q,
        'lo', greatest(0D, q.d + q.k - q.n), 'hi', least(q.k, q.d),
        'mode', least(greatest(floor((q.d + 1) * (q.k + 1) / (q.n + 2)), greatest(0D, q.d + q.k - q.n)), least(q.k, q.d)),
        'reach', cast(10 + {SPREAD} * sqrt(greatest(q.d * q.k * (q.n - q.k) * (q.n - q.d)
                      / greatest(q.n * q.n * (q.n - 1), 1D), 0D)) as int))), p ->
    aggregate(sequence(1, p.reach),
        named_struct('up', 1D, 'down', 1D, 'left', q.u * (1D +
            aggregate(sequence(1, p.reach), named_struct('up', 1D, 'down', 1D, 'sum', 0D), (s, t) ->
                transform(array(named_struct(
                    'up', if(p.mode + t > p.hi, 0D, s.up * (q.k - p.mode - t + 1) * (q.d - p.mode - t + 1)
                              / ((p.mode + t) * (q.n - q.k - q.d + p.mode + t))),
                    'down', if(p.mode - t < p.lo, 0D, s.down * (p.mode - t + 1) * (q.n - q.k - q.d + p.mode - t + 1)
                              / ((q.k - p.mode + t) * (q.d - p.mode + t))))), w ->
                    named_struct('up', w.up, 'down', w.down, 'sum', s.sum + w.up + w.down))[0], s -> s.sum)) - 1D,
            'got', p.mode),
        (s, t) -> if(s.left <= 0D, s,
            transform(array(named_struct(
                'up', if(p.mode + t > p.hi, 0D, s.up * (q.k - p.mode - t + 1) * (q.d - p.mode - t + 1)
                          / ((p.mode + t) * (q.n - q.k - q.d + p.mode + t))),
                'down', if(p.mode - t < p.lo, 0D, s.down * (p.mode - t + 1) * (q.n - q.k - q.d + p.mode - t + 1)
                          / ((q.k - p.mode + t) * (q.d - p.mode + t))))), w ->
                named_struct('up', w.up, 'down', w.down, 'left', s.left - w.up - w.down,
                    'got', if(s.left <= w.up and w.up > 0D, p.mode + t, if(w.down > 0D, p.mode - t,
                           if(w.up > 0D, p.mode + t, s.got)))))[0]),
        s -> cast(s.got as bigint)))[0])[0]"""


def _tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, counts) with the exact quota of each source (in order of rank) in each shard.

    ``quotas`` is one row with the array ``counts``. A node of several shards is divided into two; the left part gets its
    share of all tickets, drawn source by source without replacement.
    """
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    uniform = f"(pmod(xxhash64({seed}, lo, hi, i), 9007199254740992L) + 0.5D) / 9007199254740992D"
    # Tickets of a node divide as evenly over its shards as whole numbers allow.
    wanted = "cast(round(aggregate(counts, 0L, (a, x) -> a + x) * cast(div(lo + hi, 2) - lo as double) / (hi - lo)) as bigint)".replace(
        "div(lo + hi, 2)", "((lo + hi) div 2)")
    left = f"""
    aggregate(transform(counts, (x, i) -> named_struct('x', x, 'i', i)),
        named_struct('n', aggregate(counts, 0L, (a, x) -> a + x), 'd', {wanted}, 'out', cast(array() as array<bigint>)),
        (s, c) -> transform(array(if(c.x = 0 or s.d = 0, 0L, if(c.x = s.n, s.d,
            {_draw('s.n', 'c.x', 's.d', uniform.replace('i)', 'c.i)'))}))), g ->
            named_struct('n', s.n - c.x, 'd', s.d - g, 'out', concat(s.out, array(g))))[0],
        s -> s.out)"""
    levels = (shards - 1).bit_length()
    for _ in range(levels):
        split = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(left)))
        halves = F.expr("""
            if(hi - lo <= 1, array(named_struct('lo', lo, 'hi', hi, 'counts', counts)), array(
                named_struct('lo', lo, 'hi', (lo + hi) div 2, 'counts', `left`),
                named_struct('lo', (lo + hi) div 2, 'hi', hi, 'counts', zip_with(counts, `left`, (a, b) -> a - b))))""")
        nodes = split.select(F.explode(halves).alias("h")).select(
            F.col("h.lo").cast("int").alias("lo"), F.col("h.hi").cast("int").alias("hi"), "h.counts")
    return nodes.select(F.col("lo").alias("shard"), "counts")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
         shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per source: size, target, quota, tickets and ``bounds``, the last ticket of each shard plus one."""
    sizes = sized.groupBy(F.col("src.source").alias("source")).agg(F.sum("size").alias("size"))
    laid = stage(_tickets(source_targets(sizes, weights, share, most), block), "mix-targets")
    quotas = laid.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"]).alias("counts"))
    dealt = _tree(quotas, shards, seed).select("shard", F.posexplode("counts").alias("at", "tickets"))
    upto = F.sum("tickets").over(W.partitionBy("at").orderBy("shard"))
    bounds = dealt.withColumn("upto", upto).groupBy((F.col("at") + 1).alias("rank")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("bounds"))
    out = laid.join(bounds, "rank", "left").select(
        F.struct("source").alias("src"), F.col("size").alias("source_size"), "target", "quota", "blocks", "bounds")
    return stage(out, "mix-plan")


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK,
         shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """What the mix takes of each document row: its size, its source's size and target, and ``pieces``.

    A piece is (``start``, ``end``, ``copies``, ``round``, ``shard``): words of the document, counted from 0, that the mix takes
    in a round, and the shard that the tree deals the piece's first word to. Null and empty texts have no words and no
    pieces; a null source is a source of its own, last in rank; repeated rows are laid out one after the other. The same
    rows give the same mix, however they are partitioned.
    """
    sized = stage(docs.select(document_key(id_col, text_col).alias(KEY), F.struct(F.col(source_col).alias("source")).alias("src"),
                              word_count(F.col(text_col)).alias("size")), "mix-sizes")
    planned = plan(sized, block=block, shards=shards, seed=seed, **options)
    rows = sized.withColumn("place", F.xxhash64(F.lit(seed), KEY)).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)))
    buckets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    first = buckets.withColumn("first", F.sum("words").over(
        W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).drop("words")
    inside = W.partitionBy("src", "bucket").orderBy("place", KEY).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.join(first, ["src", "bucket"]).withColumn(
        "offset", F.col("first") + F.sum("size").over(inside) - F.col("size")).drop("first", "bucket")
    known = placed.join(planned, "src")
    rounds = F.expr(f"""
        transform(if(size = 0 or quota = 0, array(), sequence(0L, (quota - 1) div source_size)), r -> named_struct(
            'start', 0L, 'end', greatest(0L, least(size, quota - r * source_size - offset)), 'copies', 1, 'round', r,
            'shard', size(filter(bounds, x -> x <= (r * source_size + offset) div {block}))))""")
    return known.withColumn("pieces", F.filter(rounds, lambda p: p["end"] > 0)).select(
        KEY, "src", "size", "source_size", "target", "pieces", "blocks", "bounds")


def taken(drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of :func:`draw`: words taken of each document row, repeats counted, and ``shard_words``, the same by shard
    as ``shard:words`` joined by commas, in order of the rounds."""
    words_taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + (p["end"] - p["start"]) * p["copies"])
    return drawn.select(F.col(KEY)["id"].alias(id_col), "size", "source_size", "target", words_taken.alias("taken"),
        F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", p["shard"], p["end"] - p["start"])), ",").alias("shard_words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        chars_col: str | None = None, seed: int = SEED, **options) -> DataFrame:
    """The mixed corpus: a row per drawn piece with the document's columns, ``mix_shard`` and ``mix_order``.

    A piece that is a whole document keeps its text as it is; the document in which a quota ends keeps the white space between
    its words, and ``chars_col``, if given, holds the length of each piece. :func:`in_order` lays the shards out. A document
    that occurs on several rows gives the pieces of all of them. Texts without words are never drawn.
    """
    drawn = draw(docs, id_col, text_col, source_col, seed=seed, **options)
    rows = drawn.select(KEY, "size", F.explode("pieces").alias("p")).select(
        KEY, "size", "p.start", "p.end", F.col("p.shard").alias("mix_shard"),
        F.xxhash64(F.lit(seed + 1), KEY, "p.round").alias("mix_order"))
    per_doc = rows.groupBy(KEY).agg(F.collect_list(F.struct("size", "start", "end", "mix_shard", "mix_order")).alias("__pieces"))
    whole = docs.withColumn(KEY, document_key(id_col, text_col)).dropDuplicates([KEY]).join(per_doc, KEY)
    parts = whole.withColumn(TEXT, F.when(
        F.exists("__pieces", lambda p: p["end"] - p["start"] < p["size"]),
        F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))))
    out = parts.withColumn("__p", F.explode("__pieces"))
    piece = F.when(F.col("__p.end") - F.col("__p.start") == F.col("__p.size"), F.col(text_col)).otherwise(
        F.array_join(F.slice(TEXT, (F.col("__p.start") + 1).cast("int"), (F.col("__p.end") - F.col("__p.start")).cast("int")), ""))
    out = out.withColumn("__piece", piece)
    drawn_as = {text_col: F.col("__piece"), chars_col: F.length("__piece").cast("long")}
    return out.select(*[drawn_as.get(c, F.col(c)).alias(c) for c in docs.columns], F.col("__p.mix_shard").alias("mix_shard"), F.col("__p.mix_order").alias("mix_order"))


def in_order(mixed: DataFrame, parts: int = 64) -> DataFrame:
    """The rows of :func:`mix` laid out for writing: ``parts`` partitions' worth of each shard, in the shard's local order."""
    return mixed.repartition("mix_shard", F.pmod("mix_order", F.lit(parts))).sortWithinPartitions("mix_shard", "mix_order")
