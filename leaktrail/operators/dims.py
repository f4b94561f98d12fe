"""Dimension tables supplied by the user or derived from the fixed vocabulary, and their integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.operators.quality import missing_references, set_difference


def combos(spark: SparkSession) -> DataFrame:
    rows = [(k, e) for k, envs in v.TASK_ENV_COMBOS.items() for e in envs]
    return spark.createDataFrame(rows, "task_type string, env_type string")


def valid_combos(df: DataFrame) -> DataFrame:
    """Rows whose (task_type, env_type) belongs to the design; the design is a fixed 14-row table."""
    return df.join(F.broadcast(combos(df.sparkSession)), ["task_type", "env_type"], "left_semi")


def live_slice(tasks: DataFrame, mechanism: str) -> DataFrame:
    """Risky cells of one mechanism's tasks."""
    grid = tasks.filter(F.col("mechanism") == mechanism).join(F.broadcast(combos(tasks.sparkSession)), "task_type")
    return grid.filter(F.col("env_type").startswith("risky")).select("task_id", "task_type", "env_type")


def with_authority(df: DataFrame) -> DataFrame:
    """Authority level of (server, tool), 1 where nothing else is known."""
    dim = df.sparkSession.createDataFrame(v.RAISED_AUTHORITY, "server string, tool string, level int")
    return df.join(F.broadcast(dim), ["server", "tool"], "left").withColumn("authority", F.coalesce("level", F.lit(1))).drop("level")


def task_violations(tasks: DataFrame, per_mechanism: dict[str, int], mechanisms: list[str] | None = None) -> DataFrame:
    """Broken rules of a task registry: unknown mechanism, bad pairing, wrong counts per task type."""
    known = mechanisms or v.RISK_MECHANISMS + v.CONTROL_MECHANISMS
    out = tasks.filter(~F.col("mechanism").isin(known)).select("task_id", F.lit("unknown mechanism").alias("problem"))
    hard = tasks.filter("task_type = 'hard_negative'").select("task_id", "paired_risk")
    risk = tasks.filter("task_type = 'risk'").select(F.col("task_id").alias("paired_risk"))
    out = out.unionByName(hard.join(risk, "paired_risk", "left_anti").select("task_id", F.lit("not paired with a risk task").alias("problem")))
    out = out.unionByName(tasks.filter("task_type = 'benign' AND mechanism <> 'benign_control'").select(
        "task_id", F.lit("benign task in a risk mechanism").alias("problem")))
    for kind, expected in per_mechanism.items():
        counts = tasks.filter(F.col("task_type") == kind).groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(counts.filter(F.col("n") != expected).select(
            F.col("mechanism").alias("task_id"), F.lit(f"expected {expected} {kind} tasks").alias("problem")))
    return out


def grounding_violations(grounding: DataFrame, expected: DataFrame, key: str, text: str) -> DataFrame:
    """Keys missing or surplus on either side, and blank texts."""
    sides = set_difference(grounding, expected, key).select(F.col(key).alias("key"), F.concat(F.lit("only "), "side").alias("problem"))
    blank = grounding.filter(F.trim(F.coalesce(text, F.lit(""))) == "").select(F.col(key).alias("key"), F.lit("blank").alias("problem"))
    return sides.unionByName(blank)


def registry_counts(tasks: DataFrame, group: str) -> DataFrame:
    """Tasks per group and type, and whether every group has the same number."""
    per = tasks.groupBy("task_type", group).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("task_type").agg(F.sum("n").alias("n_tasks"), F.count(F.lit(1)).alias("n_groups"),
                                        F.min("n").alias("min_per_group"), F.max("n").alias("max_per_group"),
                                        (F.min("n") == F.max("n")).alias("uniform"))


__all__ = ["combos", "valid_combos", "live_slice", "with_authority", "task_violations", "grounding_violations", "registry_counts",
           "missing_references", "set_difference"]
