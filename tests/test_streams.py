"""Streams over several micro-batches give what the batch operators give on the whole."""

import pytest
from pyspark.sql import functions as F

from leaktrail.operators import monitor as m
from leaktrail.plans import run_queries
from leaktrail.plans.views import secret_dictionary, tool_events, tool_events_from
from leaktrail.streaming import guard as g
from leaktrail.streaming import monitor as sm

SF = "/root/testdata/sf0.001"


def test_guard_over_batches(spark, tmp_path):
    """Events arrive in three files, in time order; state carries the reads over."""
    src = spark.read.parquet(f"{SF}/events.parquet")
    cut = [0, 300, 700, 10**9]
    for i in range(3):
        src.filter((F.col("event_id") >= cut[i]) & (F.col("event_id") < cut[i + 1])).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    d = secret_dictionary(spark, SF)
    out = g.run_guard(tool_events_from(spark, SF, files), tool_events(spark, SF), d, f"{tmp_path}/out", f"{tmp_path}/cp").drop("late")
    expected = m.guard(tool_events(spark, SF), d)
    assert expected.count() > 0
    assert out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty()
    counters = {r.trace_id: r.writes_blocked for r in g.guard_counters(out).collect()}
    stats = {r.trace_id: r.writes_blocked for r in m.guard_stats(tool_events(spark, SF), expected).collect() if r.writes_blocked}
    assert counters == stats


def test_guard_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    d = secret_dictionary(spark, SF)
    expected = m.guard(tool_events(spark, SF), d)
    monkeypatch.setattr(g, "fits_broadcast", lambda *a, **k: False)
    out = g.run_guard(tool_events_from(spark, SF, files), tool_events(spark, SF), d, f"{tmp_path}/out", f"{tmp_path}/cp").drop("late")
    assert out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty()


LOG = "trace_id string, env_type string, idx bigint, tool string, args string, result_full string"


def guard_batches(spark, tmp_path, batches, ttl_ms=g.TTL_MS, pause=0.0):
    """Blocked calls after each of several micro-batches, each started anew from the checkpoint."""
    import time

    from leaktrail.functions.secrets import build_dictionary

    d = build_dictionary(spark.createDataFrame([("risky_v1", f"s{k}", f"sk_live_{k}abcdefghijklmnop") for k in range(4)], "env_type string, canary_id string, value string"))
    (tmp_path / "in").mkdir()
    files = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    log = spark.createDataFrame([r for b in batches for r in b], LOG)
    for i, rows in enumerate(batches):
        for part in (0, 1):
            spark.createDataFrame(rows[part::2], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{i}{part}")
        out = g.run_guard(files, log, d, f"{tmp_path}/out", f"{tmp_path}/cp", ttl_ms)
        yield {(r.trace_id, r.idx): (r.late, r.sanitized_args) for r in out.collect()}
        time.sleep(pause)


def _read(trace, idx, k):
    return (trace, "risky_v1", idx, "read_file", "{}", f"got sk_live_{k}abcdefghijklmnop")


def _send(trace, idx, *ks):
    return (trace, "risky_v1", idx, "write_file", '{"content": "' + " ".join(f"sk_live_{k}abcdefghijklmnop" for k in ks) + '"}', "ok")


def test_guard_late_calls_over_three_batches(spark, tmp_path):
    batches = [[_read("a", 1, 0), _send("a", 5, 0), _send("a", 6, 1), _read("b", 9, 2)],
               [_send("a", 3, 0), _read("a", 4, 1), _send("b", 2, 2), _send("b", 10, 2, 3)],
               [_send("a", 7, 0, 1), _read("a", 2, 1), _read("b", 1, 3), _send("c", 8, 0)]]
    first, second, third = guard_batches(spark, tmp_path, batches)
    assert {k: late for k, (late, _) in first.items()} == {("a", 5): False}
    # a call that comes late is checked against what was read before it, and the read of a secret late blocks later calls only
    assert {k: late for k, (late, _) in second.items()} == {("a", 5): False, ("a", 3): True, ("b", 10): False}
    assert {k: late for k, (late, _) in third.items()} == {("a", 5): False, ("a", 3): True, ("b", 10): False, ("a", 7): False}
    assert third["a", 7][1].count("REDACTED") == 2 and "sk_live_3" in third["b", 10][1] and "sk_live_2" not in third["b", 10][1]


def test_guard_state_expires(spark, tmp_path):
    batches = [[_read("a", 1, 0), _read("b", 1, 1)], [_send("a", 5, 0), _send("b", 6, 1)]]
    *_, kept = guard_batches(spark, tmp_path, batches)
    (tmp_path / "short").mkdir()
    *_, gone = guard_batches(spark, tmp_path / "short", batches, ttl_ms=1, pause=0.5)
    assert set(kept) == {("a", 5), ("b", 6)} and gone == {}


@pytest.mark.parametrize("width", [3, 1000])
def test_monitor_over_batches(spark, tmp_path, width):
    rows = run_queries._monitor_input(spark, SF).withColumn("user_id", F.col("user_id").cast("bigint"))
    n = 5
    for i in range(n):
        rows.filter(F.floor(F.col("user_id") / 4) == i if i < n - 1 else F.floor(F.col("user_id") / 4) >= i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    bucket = F.floor(F.col("user_id") / width)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sm.monitor_stream(stream, "run", "user_id", bucket, str(tmp_path / "o"), str(tmp_path / "cp"), 2_000_000).awaitTermination()
    got = run_queries._mon_cols(sm.monitored(spark, str(tmp_path / "o")))
    want = run_queries._mon_cols(m.monitor(rows, "run", "user_id", bucket, 2_000_000))
    assert want.filter("violation IS NOT NULL").count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_late_rows_go_aside(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "i int, t string").select("i", F.col("t").cast("timestamp").alias("t"))
    on_time, late = sm.split_late(df, "t", df.filter("i = 2").first().t)
    assert [r.i for r in on_time.collect()] == [2] and [r.i for r in late.collect()] == [1]
    assert sm.split_late(df, "t", None)[1].isEmpty()


def test_rows_without_a_time_go_aside(spark):
    df = spark.createDataFrame([(1, 7, None), (2, 8, "2024-01-02 00:00:00")], "i int, u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    for horizon in (None, df.filter("i = 2").first().t):
        on_time, late = sm.split_late(df, "t", horizon)
        assert [r.i for r in on_time.collect()] == [2] and [r.i for r in late.collect()] == [1]
    assert sorted((r.i, r.u) for r in sm.late_ids(on_time, late, "i", "t").collect()) == [(1, 7), (2, 8)]


def test_periodic_validation(spark, tmp_path):
    import json

    bad = [{"trace_id": f"t{i}", "events": [{"server": "sqlite", "tool": "read_query", "result_full": "Validation error"}, {"server": "shell", "tool": "x", "result_full": "error: y"}]} for i in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(t) for t in bad))
    from leaktrail import schema

    stream = spark.readStream.schema(schema.TRACE).json(str(tmp_path / "in"))
    sm.validation_stream(stream, "trace_id", str(tmp_path / "out"), str(tmp_path / "cp"), 3).awaitTermination()
    got = {r.server: (r.total, r.unhealthy) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"sqlite": (3, True), "shell": (3, False)}


def test_new_traces_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", ["e"]), ("a", "2024-01-01 00:10:00", ["e"]), ("b", "2024-01-01 00:00:00", [])], "trace_id string, t string, events array<string>")
    rows.withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trace_id string, t timestamp, events array<string>").parquet(str(tmp_path / "in"))
    out = g.run_once(sm.new_traces(stream, "trace_id", "t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.trace_id for r in out.collect()] == ["a"]


@pytest.mark.parametrize("name", ["resumed_log", "stream_windows", "stream_sessions"])
def test_late_files_are_not_lost(spark, tmp_path, name):
    """Events in four files whose times overlap, the newest rows in the first file: the result is that of one file."""
    import os

    from tests.compare import rows_of

    src = spark.read.parquet(f"{SF}/events.parquet")
    day = F.dayofmonth("ts")
    parts = [day > 20, (day <= 20) & (F.col("event_id") % 3 == 0), (day <= 20) & (F.col("event_id") % 3 == 1), (day <= 20) & (F.col("event_id") % 3 == 2)]
    (tmp_path / "events.parquet").mkdir()
    for i, cond in enumerate(parts):
        src.filter(cond).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        file = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        target = tmp_path / "events.parquet" / f"{i}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)
    query = getattr(run_queries, name)
    got, want = query(spark, str(tmp_path)), query(spark, SF)
    assert want.count() > 0
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, [tuple(r) for r in want.collect()])


def test_monitored_stream_comes_in_ordered_batches(spark, tmp_path, monkeypatch):
    """At least three batches, one after the other along user_id, give what the batch query gives."""
    monkeypatch.setattr(run_queries, "_folder", lambda *_: str(tmp_path))
    got, want = run_queries.run_monitor_stream(spark, SF), run_queries.run_monitor(spark, SF)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    spans = [spark.read.parquet(str(p)).agg(F.min("user_id"), F.max("user_id")).first()
             for p in sorted((tmp_path / "traces").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))]
    assert len(spans) >= 3
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_guard_keeps_a_trace_in_few_states(spark, tmp_path):
    """A trace that meets many secrets has a state per share, not one per secret, and each secret is judged for itself."""
    from leaktrail.functions.secrets import build_dictionary

    d = build_dictionary(spark.createDataFrame([("risky_v1", f"s{k}", f"sk_live_{k:02d}abcdefghijklmnop") for k in range(40)], "env_type string, canary_id string, value string"))
    rows = [("t", "risky_v1", k, "read_file", "{}", f"got sk_live_{k:02d}abcdefghijklmnop") for k in range(0, 40, 2)]
    rows += [("t", "risky_v1", 100 + k, "write_file", f'{{"content": "sk_live_{k:02d}abcdefghijklmnop"}}', "ok") for k in range(40)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{tmp_path}/in")
    log = spark.read.schema(LOG).parquet(f"{tmp_path}/in")
    out = g.run_guard(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), log, d, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.idx for r in out.collect()) == [100 + k for k in range(0, 40, 2)]
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{tmp_path}/cp")
    assert 0 < state.count() <= g.SHARES
