"""Anchors of needles and the windows of texts that may hold one, for dictionaries beyond the broadcast bound."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.operators.automaton import worker_cache
from leaktrail.session import importable

#: Bits of the filter per anchor, and the most bits it may have (8 MB); with fewer per anchor more false alarms pass.
BITS_PER_ANCHOR = 16
MOST_BITS = 1 << 26
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` code points."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = (h ^ codes[k:k + n]) * _FACTOR
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def needle_anchors(needles: DataFrame, key: list[str], scope: str) -> DataFrame:
    """``needles`` (a row per needle ``_needle``, unique by ``key``) with ``_anchor``: the needle's rarest ten characters.

    Rare means in few needles of the scope, so a prefix that all secrets share is nobody's anchor; a shorter needle is
    its own anchor. Empty needles go. Only dictionary rows are shuffled.
    """
    size = F.least(F.length("_needle"), F.lit(v.MIN_FRAGMENT))
    kept = needles.filter(F.length("_needle") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.length("_needle") - size + 1), lambda i: F.substring(F.col("_needle"), i, size))
    windows = kept.select(*key, F.posexplode(cut).alias("_p", "_w"))
    common = windows.groupBy(scope, "_w").agg(F.count(F.lit(1)).alias("_c"))
    best = (windows.join(common, [scope, "_w"]).groupBy(*key)
            .agg(F.min_by("_w", F.struct("_c", "_p")).alias("_anchor")))
    return kept.join(best, key)


def anchor_windows(anchors: DataFrame, text: Column) -> Column:
    """The distinct windows of ``text`` that pass a Bloom filter of all ``_anchor`` values; every anchor in it does."""
    spark = anchors.sparkSession
    importable(spark)

    @F.arrow_udf("bigint")
    def hashed(column: pa.Array) -> pa.Array:
        return pa.array([int(window_hashes(c, len(c))[0].astype(np.int64)) for c in map(code_points, column.to_pylist())], pa.int64())

    distinct = anchors.select("_anchor", F.length("_anchor").alias("_k")).distinct()
    counted = {r["_k"]: r["count"] for r in distinct.groupBy("_k").count().collect()}  # at most MIN_FRAGMENT rows
    bits = min(MOST_BITS, 1 << max(10, (BITS_PER_ANCHOR * sum(counted.values())).bit_length()))
    places = F.expr(f"array(_h & {bits - 1}L, shiftrightunsigned(_h, 32) & {bits - 1}L)")
    words = (distinct.select(hashed("_anchor").alias("_h")).select(F.explode(places).alias("_b"))
             .groupBy(F.expr("shiftright(_b, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_b & 31 AS INT)))").alias("set")))
    table = np.zeros(bits // 32, np.uint32)
    for r in words.toLocalIterator():
        table[r["word"]] = r["set"]
    sent, lengths, key = spark.sparkContext.broadcast(table.tobytes()), sorted(counted), uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def passing(column: pa.Array) -> pa.Array:
        filled = worker_cache(key, lambda: np.frombuffer(sent.value, np.uint32))

        def in_table(place: np.ndarray) -> np.ndarray:
            return filled[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1) == 1

        out, last = [], np.uint64(bits - 1)
        for t in column.to_pylist():
            found: dict[str, None] = {}
            codes = code_points(t or "")
            for k in lengths:
                h = window_hashes(codes, k)
                at = np.flatnonzero(in_table(h & last))
                at = at[in_table(h[at] >> np.uint64(32) & last)]
                found.update((t[i:i + k], None) for i in at.tolist())
            out.append(list(found))
        return pa.array(out, pa.list_(pa.string()))

    return passing(text)
