"""Feature rows and per-trace event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import text as t
from leaktrail.functions.stats import rate
from leaktrail.operators.grouped import previous


def event_counts(events: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Reads, writes, successes per kind, dangerous calls and errors of each trace, and ``more`` aggregates by name."""
    tool, ok = F.col("tool"), F.coalesce(F.col("success"), F.lit(False))
    return events.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(tool.isin(v.READ_TOOLS)).alias("reads_attempted"),
        F.count_if(tool.isin(v.WRITE_TOOLS)).alias("writes_attempted"),
        F.count_if(tool.isin(v.WRITE_TOOLS) & ok).alias("writes_succeeded"),
        F.count_if(tool.isin(v.DB_WRITE_TOOLS) & ok).alias("db_writes_succeeded"),
        F.count_if(tool.isin(v.GRAPH_WRITE_TOOLS) & ok).alias("kg_writes_succeeded"),
        F.count_if(tool.isin(v.BROWSER_INPUT_TOOLS) & ok).alias("browser_forms_succeeded"),
        F.count_if(tool.isin(v.DANGEROUS_SINKS)).alias("n_dangerous"), F.count_if(~ok).alias("n_errors"),
        *[x.alias(name) for name, x in (more or {}).items()])


def server_transitions(events: DataFrame, bucket: Column) -> DataFrame:
    """Changes of server between neighbouring events, as a share of n - 1."""
    lagged = previous(events.select("trace_id", "idx", "server"), ["trace_id"], "idx", bucket, {"before": "server"})
    out = lagged.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_events"),
                                         F.count_if(F.col("before") != F.col("server")).alias("transitions"))
    return out.withColumn("cross_server_ratio", rate("transitions", F.col("n_events") - 1))


def feature_rows(traces: DataFrame, dataset: str = "agent") -> DataFrame:
    """Flat feature row of a nested trace, marked with the name of its ``dataset``; event counts come from its own array, so nothing is shuffled."""
    c = F.col
    signals = F.col("labeling.risk_signals")
    events = F.coalesce("events", F.array().cast(dict(traces.dtypes)["events"]))

    def count(pred):
        return F.size(F.filter(events, pred))

    def num(path):
        return F.coalesce(c(path), F.lit(0))

    def flag(col):
        return F.coalesce(col.cast("int"), F.lit(0))

    n = F.size(events)
    servers = F.transform(events, lambda e: e["server"])
    changes = F.size(F.filter(F.zip_with(F.slice(servers, 1, F.greatest(n - 1, F.lit(0))), F.slice(servers, 2, F.greatest(n - 1, F.lit(0))),
                                         lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    any_risk = F.coalesce("labeling.any_risk", F.lit(False))
    crs = F.coalesce("labeling.completion_requires_secret", F.lit(False))
    text = {k: F.coalesce(c(k), F.lit("")) for k in ("task_id", "task_category", "env_type")}
    return traces.select(
        c("trace_id").alias("record_id"), F.lit(dataset).alias("dataset"), F.lit("agent").alias("stage"), "trace_id", *[x.alias(k) for k, x in text.items()],
        F.coalesce("risk_mechanism", "task_category", F.lit("")).alias("risk_mechanism"), t.env_class(text["env_type"]).alias("env_class"),
        F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("ablation_profile", F.lit("full")).alias("ablation_profile"),
        F.concat_ws("::", text["task_id"], t.env_class(text["env_type"]), F.coalesce("model", F.lit(""))).alias("group_id"),
        n.alias("n_events"), num("num_turns").alias("n_turns"),
        F.size(F.coalesce("servers_used", F.array().cast("array<string>"))).alias("n_servers"),
        count(lambda e: e["tool"].isin(v.WRITE_TOOLS)).alias("n_writes"), num("completion_checks.reads_attempted").alias("n_reads"),
        count(lambda e: e["tool"].isin(v.DANGEROUS_SINKS)).alias("n_dangerous"),
        F.when(n > 1, changes / (n - 1)).otherwise(0.0).alias("cross_server_ratio"),
        (num("tool_errors") / F.greatest(n, F.lit(1))).alias("tool_error_rate"), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        *[flag(signals[s]).alias(s) for s in v.TIERED_SIGNALS],
        num("labeling.taint_summary.taints_read").alias("taints_read"), num("labeling.taint_summary.taints_leaked").alias("taints_leaked"),
        num("labeling.taint_summary.by_method.verbatim").alias("leak_verbatim"),
        num("labeling.taint_summary.by_method.fragment_match").alias("leak_fragment"),
        flag(any_risk).alias("risky_label"), flag(crs).alias("completion_requires_secret"),
        flag(F.coalesce("labeling.intrinsic_risk", any_risk & ~crs)).alias("intrinsic_risk"),
        F.coalesce("outcome", F.lit("safe_failure")).alias("outcome"), flag(c("task_completed")).alias("task_completed"),
        flag(c("completion_checks.artifact_verified")).alias("artifact_verified"),
        F.coalesce(F.to_json("labeling.danger_chain"), F.lit("[]")).alias("danger_chain"),
        F.coalesce(F.to_json("servers_used"), F.lit("[]")).alias("servers_used_json"),
        *[num(f"measurement.{m}").alias(m) for m in ("prompt_tokens", "completion_tokens", "total_tokens", "api_retries")],
        F.coalesce("measurement.last_failure_code", F.lit("")).alias("last_failure_code"),
        F.coalesce("measurement.wire_api", "wire_api", F.lit("")).alias("wire_api"),
        F.coalesce("measurement.preset", F.lit("")).alias("preset"))


def data_path(events: DataFrame) -> DataFrame:
    """Where a browser task got its secrets from: mixed, browser or fetch, and the serving servers."""
    held = t.is_flag("canary_in_result") | t.is_flag("canary_visible_to_llm")
    out = events.groupBy("trace_id").agg(
        F.count_if((F.col("server") == "browser") & F.coalesce("success", F.lit(False))).alias("browser_ok"),
        F.max(held & (F.col("server") == "filesystem")).alias("from_files"),
        F.array_join(F.sort_array(F.collect_set(F.when(held, F.col("server")))), ",").alias("canary_read_servers"))
    path = (F.when(F.col("from_files") & (F.col("browser_ok") > 0), "mixed")
            .when(F.col("browser_ok") > 0, "browser").otherwise("fetch"))
    return out.select("trace_id", path.alias("data_path"), "canary_read_servers")
