"""SimHash near-duplicates by a self-join of binary tries (operator 5).

Two fingerprints within three bits agree on at least one of their four 16-bit blocks. So
the fingerprints are laid out four times, turned until another block leads; a block value
is the root of a trie over the other 48 bits. Each trie is joined with itself: a pair of
nodes carries the bits that differ so far, goes on to its four pairs of children and is
dropped when the differing bits exceed the budget. A root with too many fingerprints is
opened level by level into pairs of child nodes before it becomes work for a task. A task
returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaktrail.llm.graph import components, merge_labels
from leaktrail.llm.staging import quoted, stage

SEED = 42
WORDS = 3
BUDGET = 3
BLOCK = 16
#: A node pair with more fingerprints is opened before it is given to a task.
NODE_ROWS = 2_000
#: Bits by which an overfull node pair is opened at a time.
STEP = 8
#: Fingerprints that one call of a task takes up, over all its node pairs.
TASK_ROWS = 8_000
#: Node pairs or leaf pairs that are held at once.
HELD = 500_000


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint (as a signed long) of the text's word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda at, n: at + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-1]]
    spans = zip(starts, ends[words - 1:]) if len(tokens) >= words else [(0, len(joined))]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8")
    for k in range(0, len(hashes), 65_536):
        part = hashes[k:k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str) -> Column:
    """SimHash of ``text`` as a long; null and empty texts, and texts without words, have 0."""
    @F.arrow_udf("long")
    def fingerprints(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py()) for t in column], pa.int64())

    return fingerprints(text)


def turned(fp: Column, by: Column) -> Column:
    """``fp`` rotated left by ``by`` blocks."""
    return F.when(by == 0, fp).when(by == 1, _left(fp, BLOCK)).when(by == 2, _left(fp, 2 * BLOCK)).otherwise(_left(fp, 3 * BLOCK))


def _left(fp: Column, n: int) -> Column:
    return F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n))


def node_pairs(prints: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(turn, depth, a, b, bits): every fingerprint under each node pair (a, b) it must be compared in.

    a and b are the nodes' leading ``depth`` bits; the pair holds the fingerprints below both. Pairs with more than
    ``node_rows`` fingerprints are opened ``STEP`` bits at a time, keeping child pairs within the budget that exist.
    """
    if not 0 <= budget < 64 // BLOCK:
        raise ValueError("the four blocks find links of up to three bits")
    laid = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64 // BLOCK - 1))).alias("turn"))
    laid = laid.select("turn", turned(F.col("fp"), F.col("turn")).alias("bits"))
    lead = F.shiftrightunsigned("bits", 64 - BLOCK)
    current, ready = laid.select("turn", F.lit(BLOCK).alias("depth"), lead.alias("a"), lead.alias("b"), "bits"), None
    node = ["turn", "depth", "a", "b"]
    for depth in range(BLOCK, 64, STEP):
        sizes = current.groupBy(*node).count()
        full, _ = stage(sizes.where(F.col("count") > node_rows).drop("count"), "full-nodes")
        if full.isEmpty():
            return current if ready is None else ready.union(current)
        small = current.join(full, node, "left_anti")
        open_ = current.join(full, node, "left_semi").withColumn("p", F.shiftrightunsigned("bits", 64 - depth - STEP))
        children = open_.select(*node, F.col("p").alias("q")).distinct()
        other = F.shiftrightunsigned("q", STEP) == F.when(F.shiftrightunsigned("p", STEP) == F.col("a"), F.col("b")).otherwise(F.col("a"))
        near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= budget
        pairs = open_.join(children, node).where(other & near)
        opened = pairs.select("turn", F.lit(depth + STEP).alias("depth"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "bits")
        ready = small if ready is None else ready.union(small)
        current, _ = stage(opened, "nodes")
    return ready.union(current)


def join_tries(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, diff: np.ndarray, depth: int,
               budget: int, labels: np.ndarray) -> None:
    """Traverse node pairs together. ``bits`` is sorted within each range; a node is a range of it that shares ``depth`` bits.

    ``labels`` joins the positions found linked. Pairs of small nodes are compared leaf by leaf.
    """
    work = [(lo, hi, lo2, hi2, diff, depth)]
    while work:
        lo, hi, lo2, hi2, diff, depth = work.pop()
        itself = lo == lo2
        alive = (diff <= budget) & (hi > lo) & (hi2 > lo2) & ~(itself & (hi - lo < 2))
        lo, hi, lo2, hi2, diff, itself = lo[alive], hi[alive], lo2[alive], hi2[alive], diff[alive], itself[alive]
        if not len(lo):
            continue
        small = ((hi - lo) * (hi2 - lo2) <= 64) | (depth == 64)
        _leaves(bits, lo[small], hi[small], lo2[small], hi2[small], budget, labels)
        lo, hi, lo2, hi2, diff, itself = lo[~small], hi[~small], lo2[~small], hi2[~small], diff[~small], itself[~small]
        if not len(lo):
            continue
        if len(lo) > HELD // 4:
            half = len(lo) // 2
            work += [(lo[:half], hi[:half], lo2[:half], hi2[:half], diff[:half], depth), (lo[half:], hi[half:], lo2[half:], hi2[half:], diff[half:], depth)]
            continue
        mid, mid2 = _split(bits, lo, hi, depth), _split(bits, lo2, hi2, depth)
        apart = ~itself
        work.append((np.concatenate([lo, mid, lo, mid[apart]]), np.concatenate([mid, hi, mid, hi[apart]]),
                     np.concatenate([lo2, mid2, mid2, lo2[apart]]), np.concatenate([mid2, hi2, hi2, mid2[apart]]),
                     np.concatenate([diff, diff, diff + 1, diff[apart] + 1]), depth + 1))


def _split(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First position in each range whose bit at ``depth`` is 1, by bisection in all ranges at once."""
    one = np.uint64(1) << np.uint64(63 - depth)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        is_one = (bits[np.minimum(mid, len(bits) - 1)] & one) != 0
        hi = np.where(open_ & is_one, mid, hi)
        lo = np.where(open_ & ~is_one, mid + 1, lo)
    return lo


def _leaves(bits, lo, hi, lo2, hi2, budget, labels) -> None:
    size = (hi - lo) * (hi2 - lo2)
    for part in np.array_split(np.arange(len(lo)), max(1, int(size.sum()) // HELD + 1)):
        n, width = size[part], (hi2 - lo2)[part]
        if not n.sum():
            continue
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(lo[part], n) + k // np.repeat(width, n)
        j = np.repeat(lo2[part], n) + k % np.repeat(width, n)
        near = (i != j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
        merge_labels(labels, i[near], j[near])


def _linked(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """A spanning forest (u, v) over the fingerprints, turned back, of all node pairs in ``rows``."""
    bits = rows["bits"].to_numpy().astype(np.uint64)
    keys = rows[["turn", "depth", "a", "b"]].to_numpy(np.int64)
    order = np.lexsort((bits, keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
    bits, keys = bits[order], keys[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    ends = np.r_[starts[1:], len(bits)]
    labels = np.arange(len(bits))
    for depth in np.unique(keys[starts, 1]):
        at = keys[starts, 1] == depth
        lo, hi, a, b = starts[at], ends[at], keys[starts[at], 2], keys[starts[at], 3]
        same = a == b
        # a pair of two nodes: those below a come first, as a < b
        under_a = (bits >> np.uint64(64 - int(depth))).astype(np.int64) == keys[:, 2]
        cut = np.where(same, hi, lo + np.add.reduceat(under_a, starts)[at])
        join_tries(bits, lo, cut, np.where(same, lo, cut), hi, np.bitwise_count((a ^ b).astype(np.uint64)).astype(np.int64), int(depth), budget, labels)
    found = labels != np.arange(len(bits))
    back = (keys[:, 0] * BLOCK).astype(np.uint64)
    fps = np.where(back == 0, bits, (bits >> back) | (bits << ((np.uint64(64) - back) & np.uint64(63)))).astype(np.int64)
    return pd.DataFrame({"u": fps[found], "v": fps[labels[found]]})


def links(prints: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (u, v) whose components are those of all fingerprint pairs within ``budget`` bits. ``prints``: distinct ``fp``."""
    work = node_pairs(prints, budget, node_rows)
    tasks = max(1, -(-4 * prints.count() // TASK_ROWS))
    dealt = work.withColumn("task", F.pmod(F.xxhash64("turn", "depth", "a", "b"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(lambda rows: _linked(rows, budget), "u long, v long")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """(_id, _t a hash of the text, fp, component: its smallest fingerprint, component_id: its smallest id) per row."""
    prints, _ = stage(docs.select(F.col(id_col).alias("_id"), _text_key(text_col).alias("_t"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    classes, _ = stage(prints.groupBy("fp").agg(F.min("_id").alias("first")), "classes")
    reached = components(links(classes.select("fp"), budget))
    labelled = classes.join(reached, classes["fp"] == reached["u"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(labelled.join(smallest, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(``id_col``, fp, component_id): a row per row of ``docs``; ``component_id`` is the smallest id its links reach.

    Copies collapse to one fingerprint before anything is compared. Null and empty texts have fingerprint 0 and are
    linked like any other. A null id keeps its row and is never a component's id unless the component has no other.
    Repeated rows share fingerprint and component; an empty table gives no rows. Other columns are not read.
    """
    return _grouped(docs, id_col, text_col, budget).select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` for every component: the one with its smallest id (a null id comes last), of several such any one.

    Rows travel whole in a struct, so columns of any name and type come back as they were.
    """
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_t").alias("t"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    chosen = _grouped(docs, id_col, text_col, budget).groupBy("component").agg(F.min(order).alias("o")).select(
        name(F.col("o.i")).alias("_i"), F.col("o.t").alias("_t"))
    record = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("record")
    rows = docs.select(record, name(F.col(id_col)).alias("_i"), _text_key(text_col).alias("_t"))
    once = Window.partitionBy("_i", "_t").orderBy("_t")
    return rows.join(chosen, ["_i", "_t"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select("record.*")


def hexadecimal(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
