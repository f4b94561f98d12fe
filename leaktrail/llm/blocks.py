"""Exchange of hashes between blocks of documents, for the two operators on long repeated strings.

Documents are dealt once into blocks of a few megabytes. A block computes its hashes with
numpy and sends each to the route its leading bits name, packed into one row per (route,
block); a block sends a hash once however often it has it, so a very common string costs a
route one entry per block. Routes answer the blocks about the hashes that matter to them.
All steps read the same exchange of the documents, which Spark keeps and reuses.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaktrail.llm.staging import stage

#: Bytes of text per block.
BLOCK_BYTES = 4_000_000
#: A row repeated more often than this is dealt over all blocks.
HOT_COPIES = 1_000
#: Hashes that one route should take up.
ROUTE_HASHES = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and their inverses."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        size = 1 << (n - 1).bit_length()
        both = []
        for base in (_ODD, inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS, _INVERSE = both
    return _POWERS[:n], _INVERSE[:n]


class Windows:
    """Hashes of any windows of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        powers, self.inverse = _powers(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[:-1], out=self.prefix[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of the window of ``length`` at every start."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def deal(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(``_id``, ``_text``, ``_blk``) of every row, and the bytes of all texts. Other columns are left behind.

    Rows go by id and text. Where one row repeats more than ``HOT_COPIES`` times, rows go by their position too, and are
    written once so that every step sees the same blocks; no block then grows with the copies of a row.
    """
    keys = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"))
    found = keys.groupBy("i", "t", "n").count().agg(F.sum(F.col("n") * F.col("count")).alias("bytes"), F.max("count").alias("copies")).first()
    total = found.bytes or 0
    blocks = F.lit(max(1, math.ceil(total / block_bytes)))
    rows, by = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"]
    if (found.copies or 0) <= HOT_COPIES:
        return rows.withColumn("_blk", F.pmod(F.xxhash64(*by), blocks).cast("int")), total
    spread = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_blk", F.pmod(F.xxhash64(*by, "_at"), blocks).cast("int"))
    return stage(spread.drop("_at"), "dealt")[0], total


def routes_for(hashes: float, route_hashes: int = ROUTE_HASHES) -> int:
    """Bits of a hash that name its route."""
    return max(0, math.ceil(math.log2(max(1.0, hashes / route_hashes))))


def cut_by_route(keys: np.ndarray, bits: int):
    """(route, slice) of each run of the sorted ``keys`` whose leading ``bits`` agree."""
    if not len(keys):
        return
    route = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
        yield int(route[a]), slice(a, b)


def packed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def by_block_rows(block: np.ndarray, blobs, columns: list[str]) -> pd.DataFrame:
    """One row per block: the block and ``blobs`` of the positions that belong to it."""
    order = np.argsort(block, kind="stable")
    ends = np.flatnonzero(np.r_[block[order][1:] != block[order][:-1], True]) + 1 if len(order) else []
    rows, a = [], 0
    for b in ends:
        rows.append((int(block[order[a]]), *blobs(order[a:b])))
        a = b
    return packed(rows, columns)


def joined(blobs: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``keys`` is in ``sorted_keys``, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys, at


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the n positions that some [start, end) covers."""
    change = np.bincount(starts, minlength=n + 1)[:n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[:n + 1]
    return np.cumsum(change)[:n] > 0
