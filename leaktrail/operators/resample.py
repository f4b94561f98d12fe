"""Bootstrap intervals from sufficient statistics.

0/1 data needs only (n, k): a resample total is binomial, so the distribution is
sampled or inverted directly. Cluster resampling works on one (sum, count) row per
cluster. Draws come from hashes of (seed, replicate, draw), so the result does not
depend on how the data is partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions.stats import rate
from leaktrail.operators.grouped import ordered_ids
from leaktrail.operators.sampling import hash_bucket
from leaktrail.session import maybe_broadcast, staged

_LO_HI = "lo double, hi double"


def _binomial_table(n: int, k: int):
    """Support around the mean and its cumulative probabilities."""
    p = k / n
    half = 12.0 * math.sqrt(n * p * (1 - p)) + 30
    x = np.arange(max(0, math.floor(k - half)), min(n, math.ceil(k + half)) + 1)
    steps = np.log((n - x[:-1]) / (x[:-1] + 1.0)) + math.log(p / (1 - p))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return x, np.cumsum(mass) / mass.sum()


def _phi(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _quantile_2623(p: float) -> float:
    p = min(max(p, 1e-10), 1 - 1e-10)
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
    return -z if p < 0.5 else z


def _bca_one(n: int, k: int, confidence: float) -> tuple[float, float]:
    if n == 0:
        return 0.0, 0.0
    p = k / n
    if k in (0, n):
        return p, p
    x, cdf = _binomial_table(n, k)
    below = float(cdf[x < k][-1]) if (x < k).any() else 0.0
    z0 = _quantile_2623(below)
    accel = (1 - 2 * p) / (6 * math.sqrt(n * p * (1 - p)))
    out = []
    for level in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + _quantile_2623(level)
        q = _phi(z0 + z / (1 - accel * z))
        out.append(float(x[min(int(np.searchsorted(cdf, q)), len(x) - 1)]) / n)
    return round(out[0], 4), round(out[1], 4)


def bca_interval(df: DataFrame, k: str, n: str, confidence: float = 0.95, prefix: str = "ci") -> DataFrame:
    """BCa interval of a 0/1 mean on each aggregated row (limit of many resamples)."""
    @F.pandas_udf(_LO_HI)
    def udf(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bca_one(int(b), int(a), confidence) for a, b in zip(ks, ns)], columns=["lo", "hi"])

    return (df.withColumn("_ci", udf(F.col(k), F.col(n)))
            .withColumn(f"{prefix}_lo", F.col("_ci.lo")).withColumn(f"{prefix}_hi", F.col("_ci.hi")).drop("_ci"))


def difference_interval(df: DataFrame, ka: str, na: str, kb: str, nb: str, resamples: int = v.RESAMPLES, seed: int = v.SEED,
                        confidence: float = 0.95, margin: float = v.NONINFERIORITY_MARGIN) -> DataFrame:
    """Two-sample bootstrap of mean(a) - mean(b) for 0/1 data, with the non-inferiority verdict."""
    @F.pandas_udf(_LO_HI)
    def udf(a: pd.Series, m: pd.Series, b: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for k1, n1, k2, n2 in zip(a, m, b, n):
            if n1 == 0 or n2 == 0:
                out.append((0.0, 0.0))
                continue
            rng = np.random.default_rng([seed, int(k1), int(n1), int(k2), int(n2)])
            d = rng.binomial(n1, k1 / n1, resamples) / n1 - rng.binomial(n2, k2 / n2, resamples) / n2
            q = (1 - confidence) / 2
            out.append(tuple(np.round(np.quantile(d, [q, 1 - q]), 4)))
        return pd.DataFrame(out, columns=["lo", "hi"])

    both = (F.col(na) > 0) & (F.col(nb) > 0)
    return (df.withColumn("_ci", udf(F.col(ka), F.col(na), F.col(kb), F.col(nb)))
            .withColumn("diff", F.when(both, rate(ka, na) - rate(kb, nb)).otherwise(0.0))
            .withColumn("diff_lo", F.col("_ci.lo")).withColumn("diff_hi", F.col("_ci.hi"))
            .withColumn("noninferior", F.col("diff_lo") >= -margin).drop("_ci"))


def cluster_replicates(clusters: DataFrame, key: str, total: str, count: str, resamples: int, seed: int) -> DataFrame:
    """One row per replicate: the pooled mean of n clusters drawn with replacement.

    A draw is eight hex digits of SHA-256, eight draws to a digest, so any engine can
    repeat it. Work is ``resamples x clusters`` rows that never leave the executors:
    each is looked up by id (in a broadcast when the clusters are few) and summed
    map-side, so a row per replicate and task moves.
    """
    n = clusters.count()  # one number; the draws themselves stay on the executors
    ids = ordered_ids(clusters.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)), ["_h", key], hash_bucket("_h", n))
    groups = -(-max(n, 1) // 8)
    spark = clusters.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, resamples * groups // 200_000)
    drawn = spark.range(0, resamples * groups, 1, parts).select(F.expr(f"id div {groups}").alias("rep"), (F.col("id") % groups).alias("g"))
    drawn = drawn.withColumn("digest", F.sha2(F.concat_ws(":", F.lit(str(seed)), "rep", "g"), 256))
    draws = drawn.select("rep", "digest", "g", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).where(F.col("g") * 8 + F.col("j") < n)
    pick = F.pmod(F.conv(F.substring("digest", F.col("j") * 8 + 1, F.lit(8)), 16, 10).cast("bigint"), F.lit(max(n, 1)))
    values = maybe_broadcast(ids.select("id", F.col(total).alias("_t"), F.col(count).alias("_c")))
    return (draws.select("rep", pick.alias("id")).join(values, "id").groupBy("rep")
            .agg((F.sum("_t").cast("double") / F.sum("_c")).alias("stat")))


def cluster_interval(clusters: DataFrame, key: str, total: str, count: str, resamples: int = v.RESAMPLES,
                     seed: int = v.SEED, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the pooled mean when whole clusters are resampled (empty ones left out)."""
    full = staged(clusters.filter(F.col(count) > 0), "clusters")  # counted, numbered and looked up below
    q = (1 - confidence) / 2
    reps = cluster_replicates(full, key, total, count, resamples, seed)
    p = F.percentile("stat", F.array(F.lit(q), F.lit(1 - q)))
    return reps.agg(p.alias("_p")).select(
        F.coalesce(F.round(F.col("_p")[0], 4), F.lit(0.0)).alias("lo"), F.coalesce(F.round(F.col("_p")[1], 4), F.lit(0.0)).alias("hi"))


def kappa_interval(table: DataFrame, both_true: str, a_only: str, b_only: str, both_false: str,
                   resamples: int = v.RESAMPLES, seed: int = v.KAPPA_SEED) -> DataFrame:
    """Percentile interval of kappa; item resampling of a 2 x 2 table is one multinomial draw per replicate."""
    @F.pandas_udf(_LO_HI)
    def udf(tt: pd.Series, ta: pd.Series, tb: pd.Series, ff: pd.Series) -> pd.DataFrame:
        out = []
        for cells in zip(tt, ta, tb, ff):
            cells = np.asarray(cells, dtype=float)
            n = cells.sum()
            if n == 0:
                out.append((None, None))
                continue
            x = np.random.default_rng([seed, *cells.astype(int)]).multinomial(int(n), cells / n, resamples) / n
            pa, pb, po = x[:, 0] + x[:, 1], x[:, 0] + x[:, 2], x[:, 0] + x[:, 3]
            pe = pa * pb + (1 - pa) * (1 - pb)
            ks = np.sort(np.where(pe == 1, 1.0, (po - pe) / np.where(pe == 1, 1.0, 1 - pe)))
            out.append((ks[int(0.025 * len(ks))], ks[min(len(ks) - 1, int(0.975 * len(ks)))]))
        return pd.DataFrame(out, columns=["lo", "hi"])

    cols = [F.col(c) for c in (both_true, a_only, b_only, both_false)]
    return (table.withColumn("_ci", udf(*cols)).withColumn("kappa_lo", F.col("_ci.lo"))
            .withColumn("kappa_hi", F.col("_ci.hi")).drop("_ci"))
