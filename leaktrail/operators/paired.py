"""Paired arms: complete one-to-one pairing or an error, then contrasts on the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import outcome as o
from leaktrail.functions.stats import rate
from leaktrail.operators.grouped import running
from leaktrail.operators.quality import require_empty
from leaktrail.operators.resample import cluster_interval


class PairingError(ValueError):
    """The two arms do not form complete one-to-one pairs."""


def pairing_audit(baseline: DataFrame, defense: DataFrame, keys: list[str]) -> DataFrame:
    """Cells on both sides, one side only, and duplicated."""
    def side(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    j = side(baseline, "nb").join(side(defense, "nd"), keys, "full")
    return j.agg(
        F.count_if(F.col("nb").isNotNull() & F.col("nd").isNotNull()).alias("n_paired"),
        F.count_if(F.col("nd").isNull()).alias("n_baseline_only"), F.count_if(F.col("nb").isNull()).alias("n_defense_only"),
        F.count_if((F.col("nb") > 1) | (F.col("nd") > 1)).alias("n_duplicate"))


def paired_rows(baseline: DataFrame, defense: DataFrame, keys: list[str], value: str, carry: dict[str, str] | None = None,
                model: str | None = None) -> DataFrame:
    """One row per cell: ``b`` and ``d`` values; raises PairingError unless complete, unique and one model.

    ``carry`` maps output names to columns compared across the arms (prompt, snapshot);
    each gives ``<name>_b`` and ``<name>_d``.
    """
    carry = carry or {}
    if model:
        models = [r[0] for r in baseline.select(model).unionByName(defense.select(model)).distinct().limit(2).collect()]
        if len(models) > 1:
            raise PairingError(f"arms span more than one model: {sorted(map(str, models))}")
    audit = pairing_audit(baseline, defense, keys).first()
    if audit.n_baseline_only or audit.n_defense_only or audit.n_duplicate:
        raise PairingError(f"incomplete or ambiguous pairing: {audit.asDict()}")
    left = baseline.select(*keys, F.col(value).cast("int").alias("b"), *[F.col(c).alias(f"{n}_b") for n, c in carry.items()])
    right = defense.select(*keys, F.col(value).cast("int").alias("d"), *[F.col(c).alias(f"{n}_d") for n, c in carry.items()])
    return left.join(right, keys)


def discordance(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The matched 2 x 2 table, the discordant counts and the mean difference."""
    b, d = F.col("b"), F.col("d")
    out = pairs.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if((b == 1) & (d == 1)).alias("both"),
        F.count_if((b == 0) & (d == 1)).alias("b_safe_to_unsafe"), F.count_if((b == 1) & (d == 0)).alias("c_unsafe_to_safe"),
        F.count_if((b == 0) & (d == 0)).alias("neither"), F.sum(d - b).alias("sum_diff"))
    return (out.withColumn("diff", rate("sum_diff", "n_pairs"))
            .withColumn("ratio_c_over_b", rate("c_unsafe_to_safe", "b_safe_to_unsafe", None)).drop("sum_diff"))


def pair_rates(pairs: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Baseline rate and remaining rate per group, reported separately."""
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(cluster).alias("n_tasks"),
        F.sum("b").alias("baseline_unsafe"), F.sum("d").alias("residual_unsafe"))
    return out.withColumn("baseline_rate", rate("baseline_unsafe", "n_pairs")).withColumn(
        "residual_rate", rate("residual_unsafe", "n_pairs"))


def risk_only_rates(pairs: DataFrame, mechanism: str, cluster: str, special: str = "browser_to_local") -> DataFrame:
    """Aggregates over risk mechanisms only: all, the special one, the others. Controls stay out of every denominator."""
    risk = pairs.filter(~F.col(mechanism).isin(v.NON_RISK_MECHANISMS))
    group = F.when(F.col(mechanism) == special, special).otherwise("other_risk_mechanisms")
    both = risk.select("*", F.explode(F.array(F.lit("all_risk_mechanisms"), group)).alias("group"))
    return pair_rates(both, ["group"], cluster)


def task_difference_interval(pairs: DataFrame, cluster: str, resamples: int = v.RESAMPLES, seed: int = v.SEED) -> DataFrame:
    """Task-clustered percentile interval of the pair-weighted difference."""
    clusters = pairs.groupBy(cluster).agg(F.sum(F.col("d") - F.col("b")).alias("total"), F.count(F.lit(1)).alias("n"))
    return cluster_interval(clusters, cluster, "total", "n", resamples, seed)


def attribute_changes(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Pairs whose carried attribute differs between the arms."""
    return pairs.agg(*[F.count_if(~F.col(f"{n}_b").eqNullSafe(F.col(f"{n}_d"))).alias(f"{n}_diff_pairs") for n in names])


def paired_by_position(rows: DataFrame, key: str, first: Column, order: str, bucket: Column, carry: dict[str, str]) -> DataFrame:
    """The n-th row of a key in one arm beside its n-th row in the other; rows without a partner stay, with ``side`` saying whose they are."""
    numbered = running(rows.withColumn("_first", first), [key, "_first"], order, bucket, {"position": ("sum", F.lit(1))})

    def arm(cond, suffix):
        return numbered.filter(cond).select(key, "position", F.lit(True).alias(f"_{suffix}"), *[F.col(c).alias(f"{n}_{suffix}") for n, c in carry.items()])

    both = arm(F.col("_first"), "b").join(arm(~F.col("_first"), "d"), [key, "position"], "full")
    side = F.when(F.col("_d").isNull(), "baseline_only").when(F.col("_b").isNull(), "defense_only").otherwise("paired")
    return both.withColumn("side", side).drop("_b", "_d")


def registry_pairs(traces: DataFrame, registry: DataFrame, key: str, arm: str, first: str, second: str, value: Column) -> DataFrame:
    """Pair two environments on the task and require every registry task in both arms.

    Checking against the registry also catches a task missing from both arms.
    """
    grid = registry_coverage(traces, registry, key, arm, first, second, value).filter("status <> 'unregistered'")
    try:
        require_empty(grid.filter("status <> 'covered'"), "tasks without exactly one trace per arm")
    except ValueError as err:
        raise PairingError(str(err)) from None
    return grid.select(key, "b", "d")


def registry_coverage(traces: DataFrame, registry: DataFrame, key: str, arm: str, first: str, second: str, value: Column) -> DataFrame:
    """Every registry task and every task seen, with its traces per arm and how it is covered; values only where it is covered."""
    cells = traces.filter(F.col(arm).isin(first, second)).groupBy(key).agg(
        F.count_if(F.col(arm) == first).alias("n1"), F.count_if(F.col(arm) == second).alias("n2"),
        F.max(F.when(F.col(arm) == first, value.cast("int"))).alias("b"),
        F.max(F.when(F.col(arm) == second, value.cast("int"))).alias("d"))
    grid = registry.select(key, F.lit(True).alias("_listed")).join(cells, key, "full").fillna(0, ["n1", "n2"])
    n1, n2 = F.col("n1"), F.col("n2")
    status = (F.when(F.col("_listed").isNull(), "unregistered").when((n1 == 0) & (n2 == 0), "missing").when(n1 == 0, "second_only")
              .when(n2 == 0, "first_only").when((n1 > 1) | (n2 > 1), "ambiguous").otherwise("covered"))
    covered = F.col("status") == "covered"
    return grid.withColumn("status", status).select(key, "n1", "n2", "status", F.when(covered, F.col("b")).alias("b"), F.when(covered, F.col("d")).alias("d"))


def split_arms(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unmitigated risky traces: without defense, and with the taint-tracking guard."""
    level = o.mitigation_level("mitigation_level", "mitigation" if "mitigation" in traces.columns else None)
    base = traces.filter(F.col("env_type").startswith("risky") & (level == "none"))
    return base.filter(o.is_no_defense("defense")), base.filter(F.col("defense") == "taint_tracking")


def live_guard_report(baseline: DataFrame, defense: DataFrame, keys: list[str], cluster: str, mechanism: str,
                      resamples: int = v.RESAMPLES) -> dict[str, DataFrame]:
    """Safety, utility, strata and diagnostics of two arms as small frames.

    Arms need ``unsafe, useful, residual, blocked`` (0/1) per trace besides the keys.
    """
    from leaktrail.operators.resample import difference_interval

    pairs = paired_rows(baseline, defense, keys, "unsafe", {mechanism: mechanism},
                        model="model" if "model" in baseline.columns else None)
    pairs = pairs.withColumn(mechanism, F.coalesce(F.col(f"{mechanism}_d"), F.col(f"{mechanism}_b")))

    both = baseline.select("useful", F.lit("baseline").alias("arm")).unionByName(defense.select("useful", F.lit("defense").alias("arm")))
    utility = both.agg(*[x for name in ("baseline", "defense") for x in (
        F.count_if(F.col("arm") == name).alias(f"n_{name}"),
        F.count_if((F.col("arm") == name) & (F.col("useful").cast("int") == 1)).alias(f"useful_{name}"))])
    return {
        "safety": discordance(pairs),
        "safety_interval": task_difference_interval(pairs, cluster, resamples),
        "per_mechanism": pair_rates(pairs, [mechanism], cluster),
        "risk_only": risk_only_rates(pairs, mechanism, cluster),
        "utility": difference_interval(utility, "useful_defense", "n_defense", "useful_baseline", "n_baseline", resamples),
        "diagnostics": defense.groupBy(mechanism).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("n_blocked"),
            F.sum(F.col("residual").cast("int")).alias("n_residual")).withColumn("blocked_rate", rate("n_blocked", "n")),
    }


def provenance(baseline: DataFrame, defense: DataFrame, settings: list[str], ts: str) -> DataFrame:
    """One-row provenance block: windows, same-day and order tests, uniform settings."""
    both = baseline.withColumn("arm", F.lit("b")).unionByName(defense.withColumn("arm", F.lit("d")), allowMissingColumns=True)

    def pick(fn, arm):
        return fn(F.when(F.col("arm") == arm, F.col(ts)))

    def values(c):
        return F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null")))

    out = both.agg(
        F.count_if(F.col("arm") == "b").alias("n_baseline"), F.count_if(F.col("arm") == "d").alias("n_defense"),
        pick(F.min, "b").alias("baseline_first"), pick(F.max, "b").alias("baseline_last"),
        pick(F.min, "d").alias("defense_first"), pick(F.max, "d").alias("defense_last"),
        *[(values(c) == 1).alias(f"same_{c}") for c in settings])
    days = [F.to_date(c) for c in ("baseline_first", "baseline_last", "defense_first", "defense_last")]
    return (out.withColumn("same_day", (days[0] == days[1]) & (days[1] == days[2]) & (days[2] == days[3]))
            .withColumn("baseline_before_defense", F.col("baseline_last") <= F.col("defense_first")))
