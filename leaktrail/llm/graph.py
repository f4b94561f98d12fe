"""Connected components of a large graph by alternating star operations on an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaktrail.llm.staging import discard, stage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _to_minimum(both: DataFrame, larger: bool) -> DataFrame:
    """Link each neighbour of u (the larger ones, or the smaller ones and u itself) to the smallest of u's neighbourhood."""
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(lowest, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        lowest.where("u > m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, component): the smallest vertex reachable from every vertex that has an edge.

    ``edges`` has two long columns u, v in any direction, repeats allowed; nulls and loops are left out. Every round is
    two shuffles of at most one row per edge and is written to the shared folder; minima are combined before they
    move, and the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = stage(edges, "edges")
    seen = _digest(current)
    while seen[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, larger=True).where("u <> v").distinct()
        # small star: neighbours of u that are below it, in (larger, smaller) form
        small = _to_minimum(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger=False)
        after, after_path = stage(small.where("u <> v").distinct(), "edges")
        now = _digest(after)
        discard(current, path)
        current, path = after, after_path
        if now == seen:
            break
        seen = now
    # every vertex now points at its component's smallest vertex
    return current.groupBy("u").agg(F.min("v").alias("component")).union(
        current.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i[k]`` and ``j[k]`` in place; ``labels[x]`` ends as the smallest index joined with x."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped
