"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.sources.stage import stage


def settle(n: int, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Smallest row number of the component of each of ``n`` rows under links of row numbers."""
    label = np.arange(n)
    while len(lefts):
        low = np.minimum(label[lefts], label[rights])
        np.minimum.at(label, label[lefts], low)
        np.minimum.at(label, label[rights], low)
        label = label[label]
        apart = label[lefts] != label[rights]
        lefts, rights = lefts[apart], rights[apart]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def _state(edges: DataFrame) -> tuple:
    found = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(found)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of each node of the edges ``u``, ``v`` (bigint).

    Every round is joins and groupings over the edges, written to the shared folder; the number of
    rounds grows with the logarithm of the nodes. The driver sees one count and one checksum a round.
    The minimum of a node's neighbours combines before the shuffle. It is written before it is handed
    to them, so that the join is one of plain tables, which Spark splits where a node has very many.
    """
    stars = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = stage(stars.filter("u <> v").distinct(), "stars")
    before = _state(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u is tied to the smallest node around u
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "stars-low")
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        ).distinct()
        # small star: every smaller neighbour of u, and u itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        tied = large.join(low, "u")
        small = (
            tied.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .filter("u <> v")
            .union(low.select("u", F.col("low").alias("v")))
            .distinct()
        )
        stars = stage(small, "stars")
        after = _state(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
