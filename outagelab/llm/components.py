"""Distributed connected components of a link table, and local spanning forests that thin links out beforehand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import discard, stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another node; the root is the least node of its component.

    Alternates two contractions until the links form stars: every node passes its larger neighbours to its least
    neighbour, then every node passes its smaller ones. Each round is a written table, so a lost executor costs one round.
    Links of a node are never gathered: the least neighbour is an aggregate that is joined back. Links with a null end or
    from a node to itself say nothing and are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    state, mark = stage(pairs.distinct(), "links"), None
    while True:
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        outward = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        inward = outward.groupBy("u").agg(F.min("v").alias("m"))
        shrunk = (outward.join(inward, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(inward.select("u", F.col("m").alias("v"))).distinct())
        new = stage(shrunk, "links")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        discard(state)
        if seen == mark:
            break
        state, mark = new, seen
    roots = new.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs (node, least node) that connect what the pairs (i, j) over 0..n-1 connect."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        live = low < high
        if not live.any():
            break
        np.minimum.at(root, high[live], low[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]
