"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts.
EDGES = 200_000


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (u, v) of one task as stars: each node with the least node that these edges connect it with."""
    up: dict[int, int] = {}
    for part in parts:
        for u, v in zip(part["u"].tolist(), part["v"].tolist()):
            while up.setdefault(u, u) != u:
                up[u] = u = up[up[u]]
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes, roots = [], []
    for u in up:
        v = u
        while up[v] != v:
            up[v] = v = up[up[v]]
        if u != v:
            nodes.append(u)
            roots.append(v)
    yield pd.DataFrame({"u": np.array(nodes, np.int64), "v": np.array(roots, np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges (a, b) the least node it is connected with.

    Tasks of about EDGES edges contract what they hold to stars; if one task holds all, that is the answer. Otherwise the large-star step (every
    larger neighbour of a node is tied to the node's least neighbour) and the small-star step (the same for the smaller ones and the node itself)
    alternate, with contractions between, until nothing changes, which takes a logarithmic number of rounds. Neighbourhoods are never collected,
    only their minimum is taken, so a node with any number of neighbours is no hot group."""
    rows = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    left, before = rows.count(), None
    while True:
        parts = max(1, -(-left // EDGES))
        stars = rows.coalesce(parts).mapInPandas(_contract, "u long, v long")
        if parts == 1:
            rows = cut(stars)
            break
        stars = cut(stars)
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # here v < u always
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        rows = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        left, before = now[0], now
    least = rows.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return least.unionAll(rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
