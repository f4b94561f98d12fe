"""Taint guard over an event stream.

Matching is one automaton over the texts of a call (or the anchored lookup beyond the broadcast
bound), redaction is literal replacement. Only the question "was this secret read earlier in this
trace?" needs state. Per (trace, secret) that is the first read of the value and of the core, two
numbers that new reads can only lower. A call is blocked if they lie before it, so no order is
needed. The secrets of a trace are dealt into a few shares by hash and a share is one state: most
(trace, secret) pairs have one row or two, and a state for each would cost more than the rows. A
busy trace spreads over its shares, and a secret that nothing touches for ``ttl`` goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leaktrail import vocab as v
from leaktrail.functions import text as t
from leaktrail.operators.automaton import scan
from leaktrail.operators.matching import shared_windows, with_event_defaults
from leaktrail.operators.redaction import redact_known
from leaktrail.session import fits_broadcast, importable

#: How long the state of a (trace, secret) lives after its last read or call.
TTL_MS = 7 * 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CALL = "trace_id string, canary_id string, idx bigint, verbatim boolean, fragment boolean, value_known boolean, core_known boolean, late boolean"
_CALL_COLUMNS = [x.split()[0] for x in _CALL.split(", ")]
_HIT = ["canary_id", "idx", "saw_value", "saw_core", "is_delivery", "in_value", "in_core"]
_STATE = "canary_id array<string>, value_at array<bigint>, core_at array<bigint>, done array<bigint>, until array<bigint>"
_NEVER = 2**62
#: Shares that the secrets of a trace are dealt into: a task takes one share of one trace at a time.
SHARES = 2


class SeenSecret(StatefulProcessor):
    """Per (trace, share of the secrets): when each secret's value and core were first read, and its last call or read processed.

    The secrets of a group lie in one state, so that it is fetched and stored once however many rows come. Each has a
    time of its own at which it goes, ``ttl_ms`` after it was last touched.
    """

    def __init__(self, ttl_ms: int | None = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), {}
        if stored := self.seen.get():
            held = {c: (*at, until) for c, *at, until in zip(*stored) if self.ttl_ms is None or until > now}
        until = now + (self.ttl_ms or 0)
        done, calls = {c: at[2] for c, at in held.items()}, []
        for part in rows:
            for c, idx, saw_value, saw_core, call, in_value, in_core in zip(*(part[n].tolist() for n in _HIT)):
                value_at, core_at, last, _ = held.get(c) or (_NEVER, _NEVER, -1, until)
                held[c] = (min(value_at, idx) if saw_value else value_at, min(core_at, idx) if saw_core else core_at, max(last, idx), until)
                if call and (in_value or in_core):
                    calls.append((c, idx, in_value, in_core))  # of some secrets in one trace in one micro-batch, four narrow columns
        self.seen.update(tuple(map(list, zip(*((c, *at) for c, at in held.items())))))
        out = []
        for c, idx, in_value, in_core in calls:
            value_known, core_known = idx > held[c][0], idx > held[c][1]
            if (value_known and in_value) or (core_known and in_core):
                out.append((key[0], c, idx, value_known and in_value, core_known and in_core, value_known, core_known, idx <= done.get(c, -1)))
        if out:
            yield pd.DataFrame(out, columns=_CALL_COLUMNS)

    def close(self) -> None:
        pass


def _lanes(events: DataFrame) -> DataFrame:
    args = F.coalesce("args", F.lit("{}"))
    return with_event_defaults(events).select(
        "trace_id", "env_type", "idx", "tool", args.alias("raw_args"), t.strip_md(args).alias("guard_args"),
        t.strip_md(F.coalesce("result_full", F.lit(""))).alias("full"), F.col("tool").isin(v.DELIVERY_TOOLS).alias("is_delivery"))


def secret_hits(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(event, secret) hits of a stream or table: which secrets a call reads or sends; no texts go along."""
    c = F.col
    lanes = _lanes(events)
    d = dictionary.select("env_type", F.col("canary_id").cast("string").alias("canary_id"), "value", "core")
    reads = c("tool").isin(v.GUARD_READ_TOOLS)
    narrow = ["trace_id", "idx", "canary_id", "is_delivery", "saw_value", "saw_core", "in_value", "in_core"]
    if fits_broadcast(dictionary):
        texts = [F.when(reads, c("full")), F.when(c("is_delivery"), c("guard_args"))]
        found = scan(lanes, d, texts, {"_v": F.array("value"), "_c": F.array("core")}, carry={"canary_id": c("canary_id")})
        bits = {"saw_value": ("_v", 1), "saw_core": ("_c", 1), "in_value": ("_v", 2), "in_core": ("_c", 2)}
        hits = found.withColumns({n: c(kind).bitwiseAND(bit) != 0 for n, (kind, bit) in bits.items()})
    else:
        flags = {"saw_value": reads & F.contains("full", c("value")), "saw_core": reads & F.contains("full", c("core")),
                 "in_value": c("is_delivery") & F.contains("guard_args", c("value")), "in_core": c("is_delivery") & F.contains("guard_args", c("core"))}
        hits = shared_windows(lanes, d, F.concat_ws("\n", "full", "guard_args")).withColumns({n: F.coalesce(f, F.lit(False)) for n, f in flags.items()})
        hits = hits.filter("saw_value OR saw_core OR in_value OR in_core")
    return hits.withColumn("saw_core", c("saw_value") | c("saw_core")).select(*narrow)


def known_calls(events: DataFrame, dictionary: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(call, secret) rows of an event stream: calls that send a secret read earlier in their trace.

    ``late`` marks calls not behind everything already processed of their (trace, secret). A read that arrives after a
    call it should have preceded no longer blocks that call, but all later ones.
    """
    importable(events.sparkSession)
    hits = secret_hits(events, dictionary).withColumn("share", F.pmod(F.xxhash64("canary_id"), F.lit(SHARES)))
    return hits.groupBy("trace_id", "share").transformWithStateInPandas(
        statefulProcessor=SeenSecret(ttl_ms), outputStructType=_CALL, outputMode="Append", timeMode="ProcessingTime")


def redacted_calls(known: DataFrame, events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Blocked calls with redacted arguments, from (call, secret) rows and the events they belong to.

    A call has at most one row per secret, so the lists are as long as the secrets found in one call.
    """
    c = F.col
    d = dictionary.select("env_type", c("canary_id").cast("string").alias("canary_id"), "value", "core")
    calls = with_event_defaults(events).select("trace_id", "idx", "env_type", "tool", F.coalesce("args", F.lit("{}")).alias("raw_args"))
    blocked = known.select("trace_id", "idx").distinct()
    texts = calls.join(blocked, ["trace_id", "idx"], "left_semi")
    values = known.join(texts.select("trace_id", "idx", "env_type"), ["trace_id", "idx"]).join(d, ["env_type", "canary_id"])
    per_call = values.groupBy("trace_id", "idx").agg(
        F.count_if("verbatim").alias("n_verbatim"), F.count_if("fragment").alias("n_fragment"), F.max("late").alias("late"),
        F.collect_list(F.when(c("value_known"), c("value"))).alias("values"), F.collect_list(F.when(c("core_known"), c("core"))).alias("cores"))
    return texts.join(per_call, ["trace_id", "idx"]).select(
        "trace_id", "idx", "tool", "n_verbatim", "n_fragment", "late", redact_known("raw_args", "values", "cores").alias("sanitized_args"))


def run_guard(events: DataFrame, log: DataFrame, dictionary: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Guard everything a stream of events has available; blocked calls with redacted arguments.

    The stream leaves narrow (call, secret) rows under ``path``; arguments are fetched from ``log``, the stored events, only
    for blocked calls.
    """
    known = run_once(known_calls(events, dictionary, ttl_ms), path, checkpoint, empty_batches=False)
    return redacted_calls(known, log, dictionary)


def guard_counters(blocked: DataFrame) -> DataFrame:
    """Running totals per trace (update mode)."""
    return blocked.groupBy("trace_id").agg(F.count(F.lit(1)).alias("writes_blocked"),
                                           F.sum(F.col("n_verbatim") + F.col("n_fragment")).alias("values_redacted"))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True) -> DataFrame:
    """Process everything available, write to ``path`` and read it back.

    A query whose state expires by the clock always has a reason for one more batch without data; without
    ``empty_batches`` it ends with the data.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(empty_batches and before == "true").lower())
    try:  # the query takes its settings when it starts
        q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    finally:
        conf.set(name, before)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
