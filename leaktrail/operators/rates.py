"""Rates, quadrants and breakdowns of labelled traces: conditional aggregates and grouping sets.

Every function returns counts next to ratios. A group's rows are combined
map-side, so a dominant group costs no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions.outcome import is_unsafe, is_useful
from leaktrail.functions.stats import rate


def group_rates(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """n, and for each flag its count and share."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{f}") for f, c in flags.items()])
    return counted.select("*", *[rate(f"n_{f}", "n").alias(f"{f}_rate") for f in flags])


def marginal_rates(df: DataFrame, keys: list[str], sets: list[list[str]], flags: dict[str, Column]) -> DataFrame:
    """Several groupings in one pass; a key outside a row's grouping is NULL, ``level`` names the grouping."""
    named = df.select(*keys, *[c.alias(f) for f, c in flags.items()])
    agg = named.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags], F.grouping_id().alias("_gid"))
    level = F.lit(None).cast("string")
    for s in sets:
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        level = F.when(F.col("_gid") == gid, "x".join(s) or "all").otherwise(level)
    return agg.select(level.alias("level"), *keys, "n", *[f"n_{f}" for f in flags],
                      *[rate(f"n_{f}", "n").alias(f"{f}_rate") for f in flags])


def quadrants(df: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Outcome quadrant counts with utility and safety shares per grouping."""
    flags = {q: F.col("outcome") == q for q in v.OUTCOMES}
    flags.update(useful=is_useful("outcome"), safe=~is_unsafe("outcome"))
    drop = [f"{q}_rate" for q in v.OUTCOMES]
    return marginal_rates(df, keys, sets, flags).drop(*drop)


def full_grid(df: DataFrame, axes: dict[str, list], measures: list[str]) -> DataFrame:
    """Keep every cell of a fixed grid; a cell without rows shows zero. The axes are short fixed lists."""
    from itertools import product

    cells = df.sparkSession.createDataFrame(list(product(*axes.values())), list(axes))
    out = cells.join(df, list(axes), "left")
    return out.fillna(0, measures)


def two_level(df: DataFrame, unit: list[str], group: list[str], metric: Column) -> DataFrame:
    """Range of group rates over units: min and max of a rate computed one level below."""
    inner = df.groupBy(*unit, *group).agg(F.count(F.lit(1)).alias("n"), F.count_if(metric).alias("k"))
    rates = inner.withColumn("r", rate("k", "n"))
    return rates.groupBy(*group).agg(F.min("r").alias("min_rate"), F.max("r").alias("max_rate"), F.count(F.lit(1)).alias("n_units"))


def signal_prevalence(labels: DataFrame, keys: list[str], signals: list[str] | None = None) -> DataFrame:
    """Long table (keys, signal, n, fired): one aggregate over the boolean columns, then unpivoted."""
    names = signals or v.ALL_SIGNALS
    wide = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(s)).alias(s) for s in names])
    return wide.unpivot([*keys, "n"], names, "signal", "fired")


def nearer_arm(rates: DataFrame, keys: list[str], metric: str = "unsafe_rate") -> DataFrame:
    """Is the control's rate closer to the risky or to the benign arm?"""
    def arm(name):
        return F.max(F.when(F.col("env_class") == name, F.col(metric)))

    wide = rates.groupBy(*keys).agg(arm("risky").alias("risky"), arm("hard_neg").alias("hard_neg"), arm("benign").alias("benign"))
    return wide.withColumn("closer_to", F.when(
        F.abs(F.col("hard_neg") - F.col("benign")) < F.abs(F.col("hard_neg") - F.col("risky")), "benign").otherwise("risky"))


def frontier(points: DataFrame, keys: list[str], safety: str, utility: str) -> DataFrame:
    """Non-dominated (safety, utility) points.

    Sorted by safety, a point survives when its utility beats everything at least as
    safe: a running maximum, not a self join. Points are one row per (model, level).
    """
    from pyspark.sql.window import Window as W

    # distinct utility per safety level first, so the ordered pass sees one row per safety value
    best = points.groupBy(safety).agg(F.max(utility).alias("_best"))
    safer = W.orderBy(F.col(safety).desc()).rowsBetween(W.unboundedPreceding, -1)
    best = best.withColumn("_above", F.max("_best").over(safer))
    keep = (F.col(utility) == F.col("_best")) & (F.col("_above").isNull() | (F.col(utility) > F.col("_above")))
    return points.join(best, safety).withColumn("on_frontier", keep).select(*keys, safety, utility, "on_frontier")


def change_from_baseline(rates: DataFrame, keys: list[str], level: str, baseline: str, metric: str) -> DataFrame:
    """Difference of each level to the baseline level, in percentage points."""
    rates = rates.withColumn("_group", F.concat_ws("|", *keys) if keys else F.lit("all"))
    base = rates.filter(F.col(level) == baseline).select("_group", F.col(metric).alias("_base"))
    return (rates.join(base, "_group", "left")
            .withColumn("delta_pp", (F.col(metric) - F.col("_base")) * 100.0).drop("_base", "_group"))


def slices(df: DataFrame, named: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """Rates of overlapping slices in one pass: each row is counted once per slice it belongs to."""
    member = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda s: s.isNotNull())
    rows = df.select(F.explode(member).alias("slice"), *[c.alias(f) for f, c in flags.items()])
    return group_rates(rows, ["slice"], {f: F.col(f) for f in flags})


def top_counts(df: DataFrame, item: str, k: int, keys: list[str] | None = None) -> DataFrame:
    """Most common items, overall or per key; ties by name. Only counted rows are ranked."""
    from pyspark.sql.window import Window as W

    counted = df.groupBy(*(keys or []), item).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return counted.orderBy(F.desc("n"), item).limit(k)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), item))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)
