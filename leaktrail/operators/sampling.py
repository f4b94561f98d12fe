"""Reproducible samples, proportional allocation and grouped splits.

Order comes from SHA-256 of the key, so every engine and every partitioning draws
the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.operators.grouped import first_in_order, ordered_ids
from leaktrail.session import staged

#: Rows that one bucket of the hash order should hold.
BUCKET_ROWS = 50_000


def draw_order(seed, key) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def hash_bucket(h: str, rows: int) -> Column:
    """Leading hex digits of a digest, as many as ``rows`` need for buckets of about ``BUCKET_ROWS``."""
    return F.substring(h, 1, max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16))))


def eligible(traces: DataFrame) -> DataFrame:
    """Detector-clean candidates: risky, a secret was read, nothing found. ``in_pool`` leaves controls out."""
    c = F.col
    rows = traces.filter(c("env_type").startswith("risky") & ~F.coalesce("any_risk", F.lit(False))
                         & F.coalesce("sensitive_data_read", F.lit(False)))
    return rows.withColumn("in_pool", c("mechanism").isin(v.RISK_MECHANISMS))


def simple_sample(pool: DataFrame, key: str, size: int, seed=v.SAMPLE_SEED) -> DataFrame:
    """Exactly ``size`` rows without replacement (all rows when the pool is smaller)."""
    hashed = pool.withColumn("_h", draw_order(seed, key))
    if size <= BUCKET_ROWS:  # each task keeps its first rows only
        return hashed.orderBy("_h", key).limit(size).drop("_h")
    return first_in_order(hashed, ["_h", key], hash_bucket("_h", pool.count()), size).drop("_h")


def allocate(cells: DataFrame, size: int) -> DataFrame:
    """Proportional allocation by largest remainder; a cell that fills up is fixed and the rest re-split.

    ``cells`` has one row per stratum (``cell``, ``pool``). Every round is written to the shared folder; only three sums
    reach the driver between rounds, and each round fixes at least one cell.
    """
    open_ = F.col("fixed").isNull()
    current = staged(cells.filter("pool > 0").select("cell", F.col("pool").cast("bigint").alias("pool"), F.lit(None).cast("bigint").alias("fixed")), "strata")
    while True:
        sums = current.agg(F.sum("pool").alias("all"), F.coalesce(F.sum("fixed"), F.lit(0)).alias("fixed"),
                           F.coalesce(F.sum(F.when(open_, F.col("pool"))), F.lit(0)).alias("free")).first()
        target = min(size, sums["all"] or 0) - sums["fixed"]
        product = F.lit(target).cast("decimal(38,0)") * F.col("pool").cast("decimal(19,0)")
        remainder = product % F.lit(max(sums["free"], 1)).cast("decimal(19,0)")
        floor = ((product - remainder) / F.lit(max(sums["free"], 1)).cast("decimal(19,0)")).cast("bigint")
        split = current.withColumn("rem", F.when(open_, remainder)).withColumn("floor", F.when(open_, floor))
        left = target - (split.agg(F.sum("floor")).first()[0] or 0)
        more = split.filter(open_).orderBy(F.desc("rem"), "cell").limit(left).select("cell", F.lit(1).alias("more"))
        drawn = F.coalesce("fixed", F.col("floor") + F.coalesce("more", F.lit(0)))
        split = staged(split.join(more, "cell", "left").select("cell", "pool", "fixed", drawn.alias("drawn")), "strata")
        full = open_ & (F.col("drawn") >= F.col("pool"))
        state = split.agg(F.count_if(full).alias("full"), F.count_if(open_).alias("open")).first()
        if state.full in (0, state.open):
            return split.select("cell", "pool", "drawn")
        current = staged(split.select("cell", "pool", F.when(full, F.col("pool")).otherwise(F.col("fixed")).alias("fixed")), "strata")


def stratified_sample(pool: DataFrame, cell: Column, key: str, size: int, seed=v.SAMPLE_SEED) -> DataFrame:
    """Draw each stratum's allocation, with its own hash order.

    Rows are ranked per (stratum, hash bucket), so a dominant stratum spreads over
    4096 groups.
    """
    rows = pool.withColumn("cell", cell)
    quota = allocate(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("pool")), size).select("cell", F.col("drawn").alias("quota"))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "cell", F.col(key).cast("string")), 256)
    return first_in_order(rows.withColumn("_h", order), ["_h", key], hash_bucket("_h", pool.count()), quota, ["cell"]).drop("_h")


def coverage(pool: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Pool and drawn counts per cell; cells without a draw stay visible."""
    a = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool"))
    b = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("drawn"))
    return a.join(b, keys, "left").fillna(0, ["drawn"]).withColumn("uncovered", F.col("drawn") == 0)


def empty_cells(pool: DataFrame, models: DataFrame, model: str, mechanism: str) -> DataFrame:
    """(model, mechanism) positions of the design without any row of the pool."""
    mechanisms = F.array(*[F.lit(m) for m in sorted(v.RISK_MECHANISMS)])
    grid = models.select(model).distinct().select(model, F.explode(mechanisms).alias(mechanism))
    return grid.join(pool.select(model, mechanism).distinct(), [model, mechanism], "left_anti")


def grouped_split(records: DataFrame, group: str, seed: int = 0, calibration: float = 0.15, validation: float = 0.35) -> DataFrame:
    """calibration / validation / test by group, cut by rank in hash order; a group never straddles."""
    groups = records.select(group).distinct()
    key = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")), 256), 1, 8)
    groups = groups.withColumn("_k", key)
    n = groups.count()
    if n == 0:
        raise ValueError("nothing to split")
    n_cal, n_val = max(1, round(n * calibration)), max(1, round(n * validation))
    if n_cal + n_val + max(1, n - n_cal - n_val) > n:
        n_val = max(1, n_val - 1)
    ranked = ordered_ids(groups, ["_k", group], hash_bucket("_k", groups.count()), "_rank")
    split = F.when(F.col("_rank") < n_cal, "calibration").when(F.col("_rank") < n_cal + n_val, "validation").otherwise("test")
    return records.join(ranked.select(group, split.alias("split")), group)


def sample_frame_digest(pool: DataFrame, key: str) -> DataFrame:
    from leaktrail.operators.quality import table_digest

    return table_digest(pool, F.col(key).cast("string"))
