"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables (operator 8).

Rotations that make balanced binary codes are learned on a bounded sample. The code bits are
cut into substrings, one Hamming table each; two vectors are candidates when they share a
substring, that is a cell of a table. The number of bits of a substring follows the number
of vectors, the number of tables follows from the recall wanted at the threshold. Cells are
reranked with the original vectors in double precision; a pair that meets in several tables
counts in the first. Large cells are compared in blocks of rows. Only counts per vector and
a spanning forest of the links leave a task. Vectors of different lengths have no cosine;
every length that two different vectors have gets rotations and tables of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail.llm.graph import components, merge_labels
from leaktrail.llm.staging import stage

THRESHOLD = 0.9
#: At most this many vectors (the first by hash) are learned from.
SAMPLE_ROWS = 10_000
#: Share of the pairs just at the threshold that the tables should bring together; closer pairs are found more often.
RECALL = 0.97
ROUNDS = 30
SEED = 42
#: Rows of a cell that are compared at once; a larger cell is cut into blocks, and pairs of blocks are compared.
CELL_ROWS = 1_000
TASK_ROWS = 20_000
_FOUND = "vec long, other long, links long"


def usable(vector: Column | str) -> Column:
    """Whether a vector can be linked: finite, not null, empty or zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow of large components."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def plan_tables(rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring (a cell holds about eight vectors then) and number of tables for ``recall`` at ``threshold``."""
    bits = min(max(8, math.ceil(math.log2(max(rows, 2))) - 3), 48)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def learn(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """A (dim, bits) matrix of projections: rotations of the principal axes, each from another random start.

    Data is not centred: links are angles at the origin, and around a mean inside a large group its vectors would part. A rotation is improved by turns: signs of the rotated data are the best codes for it, and the rotation nearest to the
    codes comes from a singular value decomposition.
    """
    _, axes = np.linalg.eigh(sample.T @ sample)
    data, rng, out = sample @ axes, np.random.default_rng(seed), []
    for _ in range(-(-bits // axes.shape[1])):
        rotation = np.linalg.qr(rng.standard_normal(axes.shape))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(data @ rotation >= 0, 1.0, -1.0).T @ data)
            rotation = (u @ vt).T
        out.append(axes @ rotation)
    return np.concatenate(out, axis=1)[:, :bits]


def cells(vectors: np.ndarray, projection: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the substring of every vector in every table."""
    code = (unit(vectors) @ projection >= 0).reshape(len(vectors), tables, bits)
    return code @ (1 << np.arange(bits, dtype=np.int64))


def _compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of all cell blocks in ``rows``: their number per vector, and a link to the smallest vector joined with it."""
    counts: dict[int, int] = {}
    us, vs = [], []
    for (table, _, a, b), cell in rows.groupby(["table", "cell", "a", "b"], sort=False):
        if len(cell) < 2:
            continue
        cell = cell.sort_values("vec")
        ids, weight = cell["vec"].to_numpy(np.int64), cell["copies"].to_numpy(np.int64)
        v, codes = unit(np.stack(cell["v"].to_numpy())), np.stack(cell["codes"].to_numpy())
        one, other = (np.arange(len(cell)),) * 2 if a == b else (np.flatnonzero(cell["part"] == a), np.flatnonzero(cell["part"] == b))
        i, j = np.nonzero(v[one] @ v[other].T >= threshold)
        i, j = one[i], other[j]
        keep = i < j if a == b else i != j
        i, j = i[keep], j[keep]
        if table:  # met before in an earlier table?
            met = np.zeros(len(i), bool)
            for k in range(0, len(i), 100_000):
                part = slice(k, k + 100_000)
                met[part] = (codes[i[part], :table] == codes[j[part], :table]).any(axis=1)
            i, j = i[~met], j[~met]
        if not len(i):
            continue
        linked = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        for k in np.flatnonzero(linked):
            counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(linked[k])
        labels = np.arange(len(ids))
        merge_labels(labels, i, j)
        joined = np.flatnonzero(labels != np.arange(len(ids)))
        us.append(ids[joined])
        vs.append(ids[labels[joined]])
    out = pd.DataFrame({"vec": list(counts), "other": None, "links": list(counts.values())})
    if us:
        out = pd.concat([out, pd.DataFrame({"vec": np.concatenate(us), "other": np.concatenate(vs), "links": 0})])
    return out.astype({"vec": "int64", "other": "Int64", "links": "int64"})


def _links(classes: DataFrame, n: int, dim: int, threshold: float, recall: float, sample_rows: int) -> DataFrame:
    """(vec, other, links) as ``_compare`` gives them, of ``n`` different vectors of length ``dim``."""
    bits, tables = plan_tables(n, dim, threshold, recall)
    sample = classes.orderBy(F.xxhash64("vec"), "vec").limit(sample_rows).select("v").collect()
    projection = learn(unit(np.array([r.v for r in sample], np.float64)), bits * tables)

    @F.arrow_udf("array<long>")
    def codes_of(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
        out = cells(flat, projection, bits, tables) if len(column) else np.zeros((0, tables), np.int64)
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * tables, pa.array(out.ravel()))

    coded, _ = stage(classes.withColumn("codes", codes_of(F.col("v"))), "vector-codes")
    placed = coded.select("vec", "copies", "v", "codes", F.posexplode("codes").alias("table", "cell"))
    full = coded.select(F.posexplode("codes").alias("table", "cell")).groupBy("table", "cell").count().where(F.col("count") > 1)
    placed = placed.join(full, ["table", "cell"])  # a vector alone in its cell has no candidates there
    parts = F.ceil(F.col("count") / F.lit(CELL_ROWS)).cast("int")
    placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    blocks = placed.select("vec", "copies", "v", "codes", "table", "cell", "part", every).select(
        "vec", "copies", "v", "codes", "table", "cell", "part", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"))
    tasks = max(1, math.ceil(n * tables / TASK_ROWS))
    dealt = blocks.withColumn("task", F.pmod(F.xxhash64("table", "cell", "a", "b"), F.lit(tasks)))
    found = dealt.groupBy("task").applyInPandas(lambda r: _compare(r.drop(columns="task"), threshold), _FOUND)
    return stage(found, "vector-links")[0]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(``id_col``, n_links, component_id, kept): a row per row of ``vectors``.

    Links are pairs with cosine of at least ``threshold``, computed from the vectors as they are; pairs below it never
    link, nor do vectors of different lengths. Equal vectors collapse to one class before anything is compared and link
    with each other. Vectors that are null, empty, zero or not finite link with nothing; so do rows with a null id, whose
    component is null. Rows of one id count as one vector if equal. Only id and vector are read; an empty table gives no
    rows. Lengths with two different vectors or more are run one after the other.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("v"))
    good = rows.where(F.col("vec").isNotNull() & usable("v"))
    classes, _ = stage(good.groupBy("v").agg(F.min("vec").alias("vec"), F.countDistinct("vec").alias("copies")), "vector-classes")
    sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("dim").collect()
    found = vectors.sparkSession.createDataFrame([], _FOUND)
    for dim, n in sizes:
        found = found.unionByName(_links(classes.where(F.size("v") == dim), n, dim, threshold, recall, sample_rows))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    reached = components(found.where("other is not null").select(F.col("vec").alias("u"), F.col("other").alias("v")))
    judged = classes.select("v", "vec", "copies").join(links, "vec", "left").join(reached, F.col("vec") == F.col("u"), "left").select(
        F.col("v").alias("cv"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "vec").alias("component"))
    out = rows.join(judged, (F.col("v") == F.col("cv")) & F.col("vec").isNotNull(), "left")
    return out.select(F.col("vec").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec").alias("component_id"), F.coalesce(F.col("vec") == F.coalesce("component", "vec"), F.lit(False)).alias("kept"))
