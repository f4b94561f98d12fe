"""Logistic models of leaks: pseudo-R2 shares and a clustered (GEE) model.

Both work on counts per (factors) cell, so the size of the fit does not depend on
the number of traces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.session import staged


def _ll(k: Column, n: Column) -> Column:
    """Log likelihood of a group at its own rate."""
    part = lambda x: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    return part(k) + part(n - k)


def cell_counts(df: DataFrame, factors: list[str], leaked: Column) -> DataFrame:
    return df.groupBy(*factors).agg(F.count(F.lit(1)).alias("n"), F.count_if(leaked).alias("k"))


def one_factor_likelihoods(cells: DataFrame, factors: list[str]) -> DataFrame:
    """(model, log_likelihood) of the null and the single-factor models: closed forms from group rates."""
    def fit(keys, name):
        g = cells.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"))
        return g.agg(F.sum(_ll(F.col("k"), F.col("n"))).alias("log_likelihood")).select(F.lit(name).alias("model"), "log_likelihood")

    out = fit([], "null")
    for f in factors:
        out = out.unionByName(fit([f], f))
    return out


def additive_likelihood(cells: DataFrame, factors: list[str]) -> float:
    """Log likelihood of the additive logistic model, fitted by weighted IRLS on the cells."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = cells.select(*factors, F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("k").alias("w")),
                                                    F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("k")).alias("w")))).alias("c"))
    rows = rows.select(*factors, "c.y", F.col("c.w").cast("double").alias("w")).filter("w > 0")
    steps = [StringIndexer(inputCols=factors, outputCols=[f"{f}_i" for f in factors]),
             OneHotEncoder(inputCols=[f"{f}_i" for f in factors], outputCols=[f"{f}_v" for f in factors]),
             VectorAssembler(inputCols=[f"{f}_v" for f in factors], outputCol="x")]
    ready = Pipeline(stages=steps).fit(rows).transform(rows)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", featuresCol="x", weightCol="w",
                                      maxIter=100, tol=1e-12, regParam=0.0)
    return -glm.fit(ready).summary.deviance / 2.0


def deviance_shares(df: DataFrame, first: str, second: str, leaked: Column) -> DataFrame:
    """Share of the full model's McFadden pseudo-R2 that each factor reaches alone; the shares need not add up."""
    cells = staged(cell_counts(df, [first, second], leaked), "cells")
    ll = one_factor_likelihoods(cells, [first, second]).groupBy().pivot("model", ["null", first, second]).agg(F.first("log_likelihood"))
    full = additive_likelihood(cells, [first, second])
    n = cells.agg(F.sum("n")).first()[0]

    def r2(x):
        return F.lit(1.0) - x / F.col("null")

    out = ll.select(r2(F.col(first)).alias("first_r2"), r2(F.col(second)).alias("second_r2"), r2(F.lit(full)).alias("full_r2"),
                    F.lit(n).alias("n_rows"))
    return out.select("*", (F.col("first_r2") / F.col("full_r2") * 100).alias("first_share"),
                      (F.col("second_r2") / F.col("full_r2") * 100).alias("second_share"))


def _cluster_sums(beta: np.ndarray, alpha: float, x: np.ndarray, groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, information, score outer product and moment sums over clusters of (pattern, n, k) counts."""
    mu = 1.0 / (1.0 + np.exp(-(x @ beta)))
    sd = np.sqrt(mu * (1 - mu))
    p = x.shape[1]
    score, info, outer, moments = np.zeros(p), np.zeros((p, p)), np.zeros((p, p)), np.zeros(4)
    for cells in groups:
        g, n, k = (np.array([c[f] for c in cells]) for f in ("g", "n", "k"))
        g = g.astype(int)
        m, s, rows = mu[g], sd[g], x[g]
        size = n.sum()
        resid = ((k - n * m) / s).sum()
        squares = ((k * (1 - m) ** 2 + (n - k) * m ** 2) / s ** 2).sum()
        c = alpha / (1 + (size - 1) * alpha)
        w = (n * s) @ rows
        u = ((k - n * m) @ rows - c * w * resid) / (1 - alpha)
        score += u
        outer += np.outer(u, u)
        info += ((rows * (n * s ** 2)[:, None]).T @ rows - c * np.outer(w, w)) / (1 - alpha)
        moments += [squares, size, (resid ** 2 - squares) / 2, size * (size - 1) / 2]
    return score, info, outer, moments


def clustered_logit(df: DataFrame, factors: dict[str, str], cluster: str, leaked: Column, max_iter: int = 60,
                    tol: float = 1e-6) -> DataFrame:
    """GEE logistic regression, exchangeable correlation, robust errors: one row per term with odds ratio and interval.

    ``factors`` maps a column to its reference level. Traces are counted per
    (cluster, factor pattern) once; every iteration is one distributed pass that
    returns p + 2 p^2 + 4 sums.
    """
    spark = df.sparkSession
    cells = cell_counts(df, [cluster, *factors], leaked)
    levels = {f: [r[0] for r in cells.select(f).distinct().orderBy(f).collect() if r[0] != ref] for f, ref in factors.items()}
    terms = ["const"] + [f"{f}={x}" for f in factors for x in levels[f]]
    patterns = [tuple(r) for r in cells.select(*factors).distinct().orderBy(*factors).collect()]  # levels of two dimensions
    x = np.array([[1.0] + [float(p[i] == lv) for i, f in enumerate(factors) for lv in levels[f]] for p in patterns])
    index = spark.createDataFrame([(*p, i) for i, p in enumerate(patterns)], [*factors, "g"])
    by_cluster = staged(cells.join(F.broadcast(index), list(factors)).groupBy(cluster).agg(
        F.collect_list(F.struct("g", "n", "k")).alias("cells")), "clusters")  # at most one entry per pattern
    p = len(terms)

    def sums(beta, alpha):
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                parts = _cluster_sums(beta, alpha, x, b["cells"])
                flat = np.concatenate([a.ravel() for a in parts])
                yield pd.DataFrame({"i": np.arange(len(flat)), "s": flat})

        rows = by_cluster.select("cells").mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        flat = np.zeros(p + 2 * p * p + 4)
        for r in rows:
            flat[r.i] = r.s
        return flat[:p], flat[p:p + p * p].reshape(p, p), flat[p + p * p:p + 2 * p * p].reshape(p, p), flat[-4:]

    beta, alpha = np.zeros(p), 0.0
    for _ in range(max_iter):
        score, info, _, moments = sums(beta, alpha)
        step = np.linalg.solve(info, score)
        beta = beta + step
        _, _, _, moments = sums(beta, alpha) if np.abs(step).max() > tol else (None, None, None, moments)
        scale = moments[0] / (moments[1] - p)
        pairs = moments[3] - p
        alpha = float(np.clip(moments[2] / scale / pairs, -0.99, 0.99)) if pairs > 0 else 0.0
        if np.abs(step).max() <= tol:
            break
    _, info, outer, _ = sums(beta, alpha)
    bread = np.linalg.inv(info)
    se = np.sqrt(np.diag(bread @ outer @ bread))
    rows = [(t, float(b), float(s), math.exp(b), math.exp(b - v.Z95_SHORT * s), math.exp(b + v.Z95_SHORT * s),
             math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else 0.0) for t, b, s in zip(terms, beta, se)]
    return spark.createDataFrame(rows, "term string, coef double, se double, odds_ratio double, lo double, hi double, p double")
