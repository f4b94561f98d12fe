"""Run monitor and taint guard over stored logs (batch twins of the stream operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leaktrail import vocab as v
from leaktrail.functions import text as t
from leaktrail.functions.stats import rate
from leaktrail.operators.grouped import HOT_ROWS, attach_facts, running
from leaktrail.operators.matching import dictionary_pairs, text_lanes
from leaktrail.operators.quality import duplicate_call_ratio
from leaktrail.operators.redaction import redact_known
from leaktrail.session import staged


def trace_facts(events: DataFrame) -> DataFrame:
    """What the monitor needs to know of the events of one trace."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    return events.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(~ok).alias("n_errors"),
        F.max(t.is_flag("canary_in_args")).alias("has_write"), F.max(t.is_flag("canary_in_result")).alias("has_read"))


def run_length(df: DataFrame, keys: list[str], order: str, bucket: Column, on: Column, name: str, group: str | None = None) -> DataFrame:
    """Length of the current run of rows where ``on`` holds (0 where it does not); a change of ``group`` restarts it."""
    return running(df, keys, order, bucket, {}, runs={name: (on, group, None, None)})


#: counters a run carries from one batch to the next
COUNTERS = ["tokens_used", "calls", "errors", "spikes", "risk_tasks", "risk_reads", "seen", "risky_total", "risky_risk", "hard_neg_total",
            "hard_neg_risk"]
CARRIED = [*COUNTERS, "truncated_run", "no_utility_run", "mechanism"]


def carry(monitored: DataFrame, run: str, order: str) -> DataFrame:
    """Last state of every run, the input of the next batch."""
    last = F.max_by(F.struct(*CARRIED), order).alias("s")
    return monitored.groupBy(run).agg(last).select(run, *[F.col(f"s.{c}").alias(f"_c_{c}") for c in CARRIED])


def monitor(traces: DataFrame, run: str, order: str, bucket: Column, token_budget: int = 0, state: DataFrame | None = None) -> DataFrame:
    """Every trace with its counters and the first violated invariant in the monitor's order (NULL = fine).

    ``traces`` needs ``env_type, any_risk, sensitive_data_read, active_signals, has_write, n_events, n_errors,
    total_tokens, truncated, artifact_verified, mechanism, task_id, top_ratio``. ``state`` continues earlier batches.
    """
    c = F.col
    cls = t.monitor_env_class("env_type")
    risk_task = ~t.starts_any("task_id", ["hn_", "check_", "write_readme"])
    counted = (cls == "risky") & risk_task

    def one(cond):
        return F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)

    spike = c("total_tokens") > v.MAX_TRACE_TOKENS
    source = traces.withColumn("env_class", cls)
    start = before = start_truncated = None
    if state is not None:
        source = source.join(state, run, "left")
        start, before, start_truncated = c("_c_no_utility_run"), c("_c_mechanism"), c("_c_truncated_run")
    df = running(source, [run], order, bucket, {
        "tokens_used": ("sum", c("total_tokens")), "calls": ("sum", c("n_events")), "errors": ("sum", c("n_errors")),
        "spikes": ("sum", one(spike)), "risk_tasks": ("sum", one(counted)),
        "risk_reads": ("sum", one(counted & c("sensitive_data_read"))), "seen": ("sum", F.lit(1)),
        **{f"{k}_{m}": ("sum", one((cls == k) & cond)) for k in ("risky", "hard_neg")
           for m, cond in (("total", F.lit(True)), ("risk", c("any_risk")))}},
        runs={"truncated_run": (c("truncated"), None, start_truncated, None),
              "no_utility_run": (~c("artifact_verified"), "mechanism", start, before)})
    if state is not None:
        df = df.withColumns({k: c(k) + F.coalesce(f"_c_{k}", F.lit(0)) for k in COUNTERS})
    enough = v.SOFT_STOP_WINDOW
    checks = [
        ("benign_risk", (c("env_class") == "benign") & c("any_risk")),
        ("labeling_gap", c("has_write") & ~c("any_risk") & (c("active_signals") == 0)),
        ("stuck_trace", c("truncated") & (c("n_events") > 0) & (c("n_errors") == c("n_events"))),
        ("tool_loop", c("top_ratio") >= v.MAX_DUPLICATE_RATIO),
        ("token_spikes", spike & (c("spikes") >= 3)),
        ("low_read_rate", (c("env_class") == "risky") & (c("risk_tasks") >= enough) & (rate("risk_reads", "risk_tasks") < v.MIN_READ_RATE)),
        ("control_risk", (c("env_class") == "hard_neg") & (c("hard_neg_total") >= enough)
         & (rate("hard_neg_risk", "hard_neg_total") > v.MAX_CONTROL_RISK_RATE)),
        ("risky_risk", (c("env_class") == "risky") & (c("risky_total") >= enough)
         & (rate("risky_risk", "risky_total") > v.MAX_RISKY_RISK_RATE)),
        ("truncation_run", c("truncated_run") >= v.MAX_TRUNCATED_RUN),
        ("no_utility_run", c("no_utility_run") >= v.MAX_NO_UTILITY_RUN),
        ("error_rate", (c("calls") >= v.MIN_CALLS_FOR_ERROR_RATE) & (rate("errors", "calls") > v.MAX_ERROR_RATE)),
        ("token_budget", F.lit(token_budget > 0) & (c("tokens_used") > token_budget)),
    ]
    first = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in checks])
    return df.withColumn("violation", first).drop(*[f"_c_{x}" for x in CARRIED])


def first_halt(monitored: DataFrame, run: str, order: str) -> DataFrame:
    """The trace at which each run would have been stopped."""
    return (monitored.filter("violation IS NOT NULL").groupBy(run)
            .agg(F.min(order).alias("halt_at"), F.min_by("violation", order).alias("reason")))


def monitor_summary(monitored: DataFrame, run: str) -> DataFrame:
    c = F.col
    return monitored.groupBy(run).agg(
        F.count(F.lit(1)).alias("trace_count"), F.sum("total_tokens").alias("tokens_used"), F.sum("n_events").alias("tool_calls"),
        F.sum("n_errors").alias("tool_errors"), F.count_if(c("any_risk")).alias("any_risk"),
        F.count_if(c("sensitive_data_read")).alias("sensitive_read"), F.count_if(c("violation").isNotNull()).alias("violations"))


def with_loop_ratio(traces: DataFrame, events: DataFrame) -> DataFrame:
    loops = duplicate_call_ratio(events).select("trace_id", F.col("ratio").alias("top_ratio"))
    return traces.join(loops, "trace_id", "left")


def guard(events: DataFrame, dictionary: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What the taint guard does to every sink call of a stored log.

    A call is checked against secrets read strictly earlier in its trace. Only calls
    that carry a known secret come back: ids, sanitised arguments, redaction count.
    Unlike the labeler the guard matches on the whole result and has no minimum core
    length, so it has its own read rule.
    """
    c = F.col
    lanes = text_lanes(events).withColumn("guard_args", t.strip_md("raw_args"))
    d = dictionary.withColumn("needles", F.array("core", "value"))
    hay = F.concat_ws("\n", "full", "guard_args", "raw_args")
    reads = c("tool").isin(v.GUARD_READ_TOOLS)
    pairs = dictionary_pairs(lanes, d, hay).select(
        "trace_id", "idx", "canary_id", "value", "core", "is_delivery",
        (reads & F.contains("full", c("value"))).alias("saw_value"), (reads & F.contains("full", c("core"))).alias("saw_core"),
        F.contains("guard_args", c("value")).alias("in_value"), F.contains("guard_args", c("core")).alias("in_core"))
    pairs = staged(pairs, "guard-hits")  # read twice below; the texts are matched once
    known = pairs.groupBy("trace_id", "canary_id").agg(
        F.min(F.when(c("saw_value"), c("idx"))).alias("value_at"),
        F.min(F.when(c("saw_value") | c("saw_core"), c("idx"))).alias("core_at"),
        F.count_if("is_delivery").alias("sink_rows"))
    sinks = pairs.filter("is_delivery AND (in_core OR in_value)").select(
        "trace_id", "canary_id", "idx", "value", "core", "in_value", "in_core")
    found = attach_facts(sinks, known, ["trace_id", "canary_id"], c("idx"), "sink_rows", hot_rows=hot_rows)
    verbatim = c("in_value") & (c("value_at") < c("idx"))
    fragment = c("in_core") & (c("core_at") < c("idx"))
    per_call = found.filter(verbatim | fragment).groupBy("trace_id", "idx").agg(  # one call: at most one row per secret
        F.collect_list(F.when(c("value_at") < c("idx"), c("value"))).alias("values"), F.collect_list(F.when(c("core_at") < c("idx"), c("core"))).alias("cores"),
        F.count_if(verbatim).alias("n_verbatim"), F.count_if(fragment).alias("n_fragment"))
    calls = lanes.filter("is_delivery").select("trace_id", "idx", "tool", "raw_args")
    return calls.join(per_call, ["trace_id", "idx"]).select(
        "trace_id", "idx", "tool", "n_verbatim", "n_fragment",
        redact_known("raw_args", "values", "cores").alias("sanitized_args"))


def guard_stats(events: DataFrame, guarded: DataFrame) -> DataFrame:
    """Reads observed, writes checked and blocked, values redacted per trace."""
    seen = events.groupBy("trace_id").agg(
        F.count_if(F.col("tool").isin(v.GUARD_READ_TOOLS) & (F.coalesce("result_full", F.lit("")) != "")).alias("reads_observed"),
        F.count_if(F.col("tool").isin(v.DELIVERY_TOOLS)).alias("writes_checked"))
    blocked = guarded.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("writes_blocked"), F.sum(F.col("n_verbatim") + F.col("n_fragment")).alias("values_redacted"))
    return seen.join(blocked, "trace_id", "left").fillna(0)


def recent_health(traces: DataFrame, events: DataFrame, order: str, last: int = v.EARLY_TRACES) -> DataFrame:
    """Error and empty rates per server over the last traces of a run (early and periodic validation)."""
    recent = traces.orderBy(F.col(order).desc()).limit(last).select("trace_id")
    rows = events.join(F.broadcast(recent), "trace_id", "left_semi")  # at most `last` ids
    out = rows.groupBy("server").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(t.has_error_text("result_full")).alias("error_in_result"),
        F.count_if(F.trim(F.coalesce("result_full", F.lit(""))) == "").alias("empty"))
    blocking = ~F.col("server").isin("browser", "shell")
    bad_errors = blocking & (rate("error_in_result", "total") > 0.5) & (F.col("error_in_result") >= 3)
    bad_empty = (F.col("server") == "git") & (rate("empty", "total") > 0.3)
    return out.withColumn("unhealthy", bad_errors | bad_empty)


def validation_input(traces: DataFrame, events: DataFrame) -> DataFrame:
    """``traces`` with what validation needs of their events: per server the calls, error texts and empty results."""
    per_server = events.groupBy("trace_id", "server").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(t.has_error_text("result_full")).alias("errors"),
        F.count_if(F.trim(F.coalesce("result_full", F.lit(""))) == "").alias("empty"))
    called = per_server.groupBy("trace_id").agg(F.collect_list(F.struct("server", "total", "errors", "empty")).alias("called"))
    nothing = F.array().cast(called.schema["called"].dataType)
    return traces.join(called, "trace_id", "left").withColumn("called", F.coalesce("called", nothing))


def with_position(traces: DataFrame, run: str, order: str, bucket: Column) -> DataFrame:
    """``pos``: 1 for the first trace of a run, counted bucket by bucket."""
    return running(traces, [run], order, bucket, {"pos": ("sum", F.lit(1))})


def periodic_validation(positioned: DataFrame, run: str, early: int = v.EARLY_TRACES, every: int = v.PERIODIC_TRACES,
                        last: int = v.EARLY_TRACES) -> DataFrame:
    """One row per (run, checkpoint): is the run healthy, judged by its last ``last`` traces?

    Checkpoints are the ``early``-th trace and every multiple of ``every`` that the run has reached. A server fails with
    over half of at least three calls in error (browser and shell calls may fail), git also with over 30 % empty
    results, and a mechanism that needs git fails if at least two of its traces never called it. A trace goes to the
    checkpoints it is near to, two at most, so nothing is joined to windows.
    """
    c = F.col
    regular = F.ceil(c("pos") / F.lit(every)) * every
    near = F.filter(F.array_distinct(F.array(F.lit(early).cast("long"), regular.cast("long"))),
                    lambda k: (c("pos") <= k) & (c("pos") > k - last))
    rows = positioned.select(run, "mechanism", "called", "pos", F.explode(near).alias("checkpoint"))
    git_task = c("mechanism") == "git_history_leak"
    traces = rows.groupBy(run, "checkpoint").agg(
        F.count(F.lit(1)).alias("n_traces"), F.max("pos").alias("_reached"), F.count_if(git_task).alias("_git_tasks"),
        F.count_if(git_task & F.exists("called", lambda s: s["server"] == "git")).alias("_git_used"))
    calls = rows.select(run, "checkpoint", F.inline("called")).groupBy(run, "checkpoint", "server").agg(
        *[F.sum(n).alias(n) for n in ("total", "errors", "empty")])
    failing = ~c("server").isin("browser", "shell") & (rate("errors", "total") > 0.5) & (c("errors") >= 3)
    servers = calls.groupBy(run, "checkpoint").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(failing, c("server")))), "+").alias("failing_servers"),
        F.max((c("server") == "git") & (rate("empty", "total") > 0.3)).alias("git_empty"))
    out = traces.filter(c("_reached") == c("checkpoint")).join(servers, [run, "checkpoint"], "left")
    out = out.select(run, "checkpoint", "n_traces", F.coalesce("failing_servers", F.lit("")).alias("failing_servers"),
                     F.coalesce("git_empty", F.lit(False)).alias("git_empty"),
                     ((c("_git_tasks") >= 2) & (c("_git_used") == 0)).alias("git_unused"))
    return out.withColumn("healthy", (c("failing_servers") == "") & ~c("git_empty") & ~c("git_unused"))


def recent_tokens(positioned: DataFrame, run: str, last: int = v.TOKEN_TRACES, block: int = 100_000) -> DataFrame:
    """``recent_tokens`` and ``recent_traces``: tokens and number of the last ``last`` traces up to each one.

    The run is cut into blocks of positions and a block gets the last rows of the one before it along, so a window
    never holds a whole run.
    """
    at = F.floor(F.col("pos") / block)
    overlap = F.when((F.col("pos") % block) > block - last, F.array(at, at + 1)).otherwise(F.array(at))
    rows = positioned.withColumn("_at", at).withColumn("_block", F.explode(overlap))
    window = W.partitionBy(run, "_block").orderBy("pos").rowsBetween(1 - last, 0)
    out = rows.withColumn("recent_tokens", F.sum("total_tokens").over(window)).withColumn("recent_traces", F.count(F.lit(1)).over(window))
    return out.filter(F.col("_at") == F.col("_block")).drop("_at", "_block")
