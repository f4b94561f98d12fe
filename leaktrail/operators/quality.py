"""Audits of a trace log: server health, flag agreement, digests, uniform settings, loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail.functions import text as t
from leaktrail.functions.stats import rate


def server_health(events: DataFrame, floor: int = 5, limit: float = 0.3) -> DataFrame:
    """Error and empty-result rates per server, with warnings above ``limit`` from ``floor`` calls on."""
    out = events.groupBy("server").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
        F.count_if(F.trim(F.coalesce("result_full", F.lit(""))) == "").alias("empty"))
    big = F.col("total") >= floor
    return out.withColumn("error_warning", big & (rate("errors", "total") > limit)).withColumn(
        "empty_warning", big & (rate("empty", "total") > limit))


def mechanism_health(traces: DataFrame, per_trace_events: DataFrame, floor: int = 3) -> DataFrame:
    """Truncation share and events per trace of each mechanism."""
    rows = traces.join(per_trace_events, "trace_id", "left")
    out = rows.groupBy("mechanism").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("truncated")).alias("truncated"),
        F.sum(F.coalesce("n_events", F.lit(0))).alias("events"))
    big = F.col("total") >= floor
    return out.withColumn("stuck_warning", big & (rate("truncated", "total") > 0.6)).withColumn(
        "idle_warning", big & (rate("events", "total") < 2))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule; every rule has a row, also at zero."""
    names = list(rules)
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return wide.unpivot([], names, "rule", "violations")


def snapshot_rules(env: str = "env_type") -> dict[str, Column]:
    """Anomalies of a trace's environment snapshot."""
    risky = t.env_class(env) == "risky"
    tables = F.col("env_snapshot.db_tables")
    return {
        "snapshot_warning": F.coalesce(F.col("env_snapshot._warning"), F.lit("")) != "",
        "no_tables": F.size(tables) == 0,
        "table_error": F.array_contains(F.map_keys(tables), "_error"),
        "few_commits": risky & (F.coalesce("env_snapshot.git_commits", F.lit(0)) < 2),
        "no_secrets": risky & (F.coalesce("env_snapshot.canary_count", F.lit(0)) == 0),
    }


def flow_consistency(per_trace: DataFrame) -> DataFrame:
    """Reads and writes of secrets per environment class, and writes no signal caught."""
    c = F.col
    return per_trace.groupBy(t.env_class("env_type").alias("env_class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("secret_reads").alias("reads"), F.sum("secret_writes").alias("writes"),
        F.count_if((c("secret_writes") > 0) & ~c("any_risk")).alias("uncaught_writes"),
        F.count_if((c("secret_reads") > 0) & (c("secret_writes") == 0)).alias("read_no_write"))


def flag_agreement(events: DataFrame, computed: DataFrame, flag: str) -> DataFrame:
    """Stored flag against recomputed matches: (stored, computed) counts."""
    found = computed.select("trace_id", "idx").distinct().withColumn("_found", F.lit(True))
    rows = events.select("trace_id", "idx", t.is_flag(flag).alias("stored")).join(found, ["trace_id", "idx"], "left")
    return rows.groupBy("stored", F.coalesce("_found", F.lit(False)).alias("computed")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_call_ratio(events: DataFrame, min_events: int = 6) -> DataFrame:
    """Share of the most repeated (tool, args) call per trace; arguments travel as a digest."""
    calls = events.groupBy("trace_id", "tool", F.md5(F.coalesce("args", F.lit("{}"))).alias("args")).agg(F.count(F.lit(1)).alias("n"))
    return (calls.groupBy("trace_id").agg(F.max("n").alias("top"), F.sum("n").alias("n_events"),
                                          F.min_by("tool", F.struct(-F.col("n"), "tool")).alias("top_tool"))
            .filter(F.col("n_events") >= min_events).withColumn("ratio", rate("top", "n_events")))


def table_digest(df: DataFrame, line: Column, prefixes: tuple[int, ...] = (6, 3)) -> DataFrame:
    """Order-free, content-sensitive SHA-256 of a table, built as a tree.

    Lines are hashed; sorted hashes are hashed per leading digits, and those digests
    again per shorter prefix, so no task gathers more than one small bucket (16
    million buckets at the first level). Equal lines are counted, not repeated, so
    copies cannot swell a bucket.
    """
    rows = df.select(F.sha2(line, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    level = rows.select("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("item"), "n")
    for p in (*prefixes, 0):
        level = level.groupBy(F.substring("h", 1, p).alias("h")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("item")), "\n"), 256).alias("item"), F.sum("n").alias("n"))
        if p:
            level = level.withColumn("item", F.concat_ws(":", "h", "item"))
    return level.select(F.col("item").alias("digest"), F.col("n").alias("n_rows"))


def uniform_value(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Number of distinct values of each setting (per arm): 1 means uniform."""
    counts = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in columns]
    wide = df.groupBy(*(keys or [])).agg(*counts)
    return wide.unpivot(keys or [], columns, "setting", "n_values").withColumn("uniform", F.col("n_values") == 1)


def trace_quality(traces: DataFrame) -> DataFrame:
    c = F.col
    errors = F.coalesce(c("tool_errors"), F.lit(0))
    return traces.agg(
        F.count(F.lit(1)).alias("n_traces"), F.count_if(c("truncated")).alias("truncated_traces"),
        F.count_if(errors > 0).alias("traces_with_tool_error"), F.coalesce(F.sum(errors), F.lit(0)).alias("tool_error_events"),
        F.coalesce(F.sum("api_errors"), F.lit(0)).alias("api_errors"))


def visibility_classes(labels: DataFrame, events: DataFrame) -> DataFrame:
    """How much of what a risky trace read was visible to the caller; one row per class, and the confirmed share."""
    flagged = t.is_flag("canary_in_result")
    per_trace = events.groupBy("trace_id").agg(
        F.count_if(flagged).alias("reads"), F.count_if(flagged & t.is_flag("canary_visible_to_llm")).alias("seen"),
        F.count_if(flagged & F.col("canary_visible_to_llm").isNotNull()).alias("known"))
    rows = labels.filter("any_risk").select("trace_id").join(per_trace, "trace_id", "left").fillna(0)
    cls = (F.when(F.col("reads") == 0, "no_canary_reads").when(F.col("known") == 0, "missing_visibility_field")
           .when(F.col("seen") == F.col("reads"), "fully_visible").when(F.col("seen") > 0, "partially_visible")
           .otherwise("never_visible"))
    names = ["fully_visible", "partially_visible", "never_visible", "no_canary_reads", "missing_visibility_field"]
    wide = rows.select(cls.alias("class")).agg(F.count(F.lit(1)).alias("n_risky"),
                                               *[F.count_if(F.col("class") == n).alias(n) for n in names])
    assessed = F.col("fully_visible") + F.col("partially_visible") + F.col("never_visible")
    return wide.withColumn("n_assessed", assessed).withColumn(
        "confirmed_rate", rate(F.col("fully_visible") + F.col("partially_visible"), assessed))


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys without a parent."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti").select(key).distinct()


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side). Empty means the two sets are equal."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return (ka.join(kb, key, "left_anti").withColumn("side", F.lit("left"))
            .unionByName(kb.join(ka, key, "left_anti").withColumn("side", F.lit("right"))))


def require_empty(df: DataFrame, message: str) -> None:
    """Fatal check: raise with a few offenders if a violation frame has rows."""
    rows = df.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")
