"""Readers, writers and their checks on files."""

import hashlib
import json

import pytest
from leaktrail.operators import dims
from leaktrail.session import settings
from leaktrail.sources import logs
from pyspark.sql import functions as F


def trace(tid, model="m", n=1, **kw):
    return {"trace_id": tid, "model": model, "env_type": "risky_v1", "mitigation_level": "none", "defense": "none",
            "events": [{"turn": i, "server": "s", "tool": "t", "args": {"path": f"/p{i}", "deep": {"a": [1]}}, "result_full": "r"} for i in range(n)], **kw}


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return path


def test_load_traces(spark, tmp_path):
    put(tmp_path / "a" / "agent_traces.json", {"schema_version": "2", "traces": [trace("t1", note=1), trace("t2", outcome="safe_success")]})
    put(tmp_path / "b" / "agent_traces_x.json", [trace("t2", outcome="other"), trace("t2", model="n"), trace("t3")])
    put(tmp_path / "b" / "agent_traces.checkpoint.json", [trace("t9")])
    put(tmp_path / "c" / "agent_traces.json", "{broken")
    put(tmp_path / "c" / "other.json", [trace("t8")])
    got = logs.load_traces(spark, str(tmp_path))
    assert sorted((r.model, r.trace_id) for r in got.collect()) == [("m", "t1"), ("m", "t2"), ("m", "t3"), ("n", "t2")]
    assert got.filter("trace_id = 't2' AND model = 'm'").first().outcome == "safe_success"
    assert got.filter("trace_id = 't1'").first().schema_version == "2"
    assert logs.load_traces(spark, str(tmp_path), "n").count() == 1
    e = logs.explode_events(got).filter("trace_id = 't1'").first()
    assert e.idx == 0 and json.loads(e.args) == {"path": "/p0", "deep": {"a": [1]}}


def test_lines_fallback_and_resume(spark, tmp_path):
    lines = [json.dumps(trace("t1", outcome="old")), "not json", json.dumps(trace("t2", n=0)), json.dumps(trace("t1", outcome="new")), json.dumps(trace("t4"))]
    put(tmp_path / "agent_traces.checkpoint.jsonl", "\n".join(lines))
    got = {r.trace_id: r.outcome for r in logs.load_all(spark, [str(tmp_path)]).collect()}
    assert got == {"t1": "new", "t4": None}
    put(tmp_path / "main" / "agent_traces.json", [trace("t1", outcome="main"), trace("t5", n=0)])
    main, appended = logs.load_traces(spark, str(tmp_path / "main")), logs.read_lines(spark, str(tmp_path))
    assert sorted(r.trace_id for r in logs.resume(main, appended).collect()) == ["t1", "t4"]


def test_line_order_follows_paths_not_sizes(spark, tmp_path):
    def lines(name, values):
        path = tmp_path / "logs" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"trace_id": i, "model": m, "events": [{"turn": 1, "args": pad}]}) + "\n" for i, m, pad in values))

    lines("a.jsonl", [("t", "from_a", ""), ("t", "later_in_a", "")])
    lines("b.jsonl", [("t", "from_b", "x" * 50_000)] + [(f"u{k}", "b", "x" * 2000) for k in range(50)])
    lines("c.jsonl", [("v", "first", ""), ("v", "second", "")])
    rows = {r.trace_id: r.model for r in logs.load_all(spark, [str(tmp_path / "logs")]).collect()}
    assert (rows["t"], rows["v"]) == ("from_b", "second")
    main = logs.read_lines(spark, str(tmp_path / "logs"), "none*")
    resumed = {r.trace_id: r.model for r in logs.resume(main, logs.read_lines(spark, str(tmp_path / "logs"), ordered=True)).collect()}
    assert (resumed["t"], resumed["v"], len(resumed)) == ("from_a", "first", 52)


def test_load_arm(spark, tmp_path):
    good = put(tmp_path / "g.json", {"schema_version": "2", "traces": [trace("t1")]})
    assert logs.load_arm(spark, str(good), "none").first().schema_version == "2"
    mixed = put(tmp_path / "m.json", {"traces": [trace("t1"), trace("t2", defense="taint_tracking")]})
    with pytest.raises(ValueError):
        logs.load_arm(spark, str(mixed), "none")
    with pytest.raises(ValueError):
        logs.load_arm(spark, str(put(tmp_path / "e.json", {"traces": []})), "none")


HEAD = "row,task_id,mechanism,task_type,description,your_crs_label\n"


def test_sheets(spark, tmp_path):
    ok = put(tmp_path / "ok.csv", HEAD + "1,a,m,risk,d,TRUE\n2,b,m,risk,\"d, e\",no\n")
    assert sorted(tuple(r) for r in logs.read_sheet(spark, str(ok)).collect()) == [("a", True), ("b", False)]
    for name, body in {"dup": "1,a,m,r,d,T\n2,a,m,r,d,F\n", "blank": "1,a,m,r,d,\n", "unknown": "1,a,m,r,d,maybe\n", "id": "1,,m,r,d,T\n"}.items():
        with pytest.raises(ValueError):
            logs.read_sheet(spark, str(put(tmp_path / f"{name}.csv", HEAD + body)))
    with pytest.raises(ValueError):
        logs.read_sheet(spark, str(put(tmp_path / "col.csv", "a,b\n1,2\n")))


def test_regression_and_digest(spark, tmp_path):
    body = "model,task_id,mechanism,env_variant,is_crs,leaked,utility\nm,t,x,e,0,1,1\nm,u,x,e,1,0,1\n"
    p = put(tmp_path / "r.csv", body)
    assert logs.read_regression(spark, str(p)).count() == 1 and logs.read_regression(spark, str(p), False).count() == 2
    with pytest.raises(ValueError):
        logs.read_regression(spark, str(put(tmp_path / "bad.csv", "model\nm\n")))
    assert logs.file_digests(spark, str(p)).first().sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_digests_of_files_beyond_one_array(spark, tmp_path):
    """Files longer than Spark's binary reader holds in memory, and odd names; the bytes are taken as they lie, compressed or not."""
    bodies = {"a b%20é#1.json": b"\xef\xbb\xbf{}\r\n\n", "l.json.gz": b"\x1f\x8b no gzip", "part[0].bin": bytes(range(256)) * 3000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    with settings(spark, {"spark.sql.sources.binaryFile.maxLength": "1"}):
        digests = logs.file_digests(spark, str(tmp_path))
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in digests.collect()}
        big = digests.filter(F.col("sha256") == hashlib.sha256(bodies["part[0].bin"]).hexdigest()).select("length").collect()
    assert got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
    assert [r.length for r in big] == [768_000]


def test_sinks(spark, tmp_path):
    put(tmp_path / "in" / "agent_traces.json", [trace("t1"), trace("t2", model="n")])
    df = logs.load_traces(spark, str(tmp_path / "in"))
    logs.write_log(df, str(tmp_path / "log"), {"labeling_rules_version": "x"})
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and back.first().labeling_rules_version == "x" and {"model", "env_class"} <= set(back.columns)
    with pytest.raises(Exception):
        logs.write_report(df.select("trace_id"), str(tmp_path / "log"))
    logs.write_points(df.select("trace_id", "model"), str(tmp_path / "points"))
    assert spark.read.option("header", True).csv(str(tmp_path / "points")).count() == 2


def test_append_stream(spark, tmp_path):
    put(tmp_path / "in" / "a.jsonl", json.dumps(trace("t1")))
    stream = spark.readStream.schema("trace_id string, model string").json(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        logs.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_sanitized_copy(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a", "x /Users/bob/y"), (2, "b", "nothing"), (3, "c", "C:UsersAdministrator")], "id int, task string, text string")
    bad = logs.write_sanitized(raw, "id", "text", ["task"], str(tmp_path / "clean"))
    assert bad.isEmpty()
    assert {r.id: r.clean for r in spark.read.parquet(str(tmp_path / "clean")).collect()} == {1: "x /home/user/y", 3: "<HOME>"}


def test_dimensions(spark):
    tasks = spark.createDataFrame([("r1", "file_to_file", "risk", ""), ("h1", "file_to_file", "hard_negative", "r1"), ("h2", "file_to_file", "hard_negative", "zz"),
                                   ("b1", "file_to_file", "benign", ""), ("u1", "odd", "risk", "")], "task_id string, mechanism string, task_type string, paired_risk string")
    got = sorted(tuple(r) for r in dims.task_violations(tasks, {"risk": 1, "hard_negative": 1}).collect())
    assert got == sorted([("u1", "unknown mechanism"), ("h2", "not paired with a risk task"), ("b1", "benign task in a risk mechanism"), ("file_to_file", "expected 1 hard_negative tasks")])
    assert dims.live_slice(tasks, "file_to_file").count() == 3 + 2 + 3
    g = spark.createDataFrame([("file_to_file", "x"), ("extra", " ")], "k string, t string")
    want = spark.createDataFrame([("file_to_file",), ("odd",)], "k string")
    assert sorted(tuple(r) for r in dims.grounding_violations(g, want, "k", "t").collect()) == [("extra", "blank"), ("extra", "only left"), ("odd", "only right")]


def test_judge_sees_the_whole_arguments(spark, tmp_path):
    """A secret behind a long text reaches the evidence of the outbound call."""
    from leaktrail.plans.source_queries import judge_evidence

    texts = ["x" * 5000 + " sk_live_1", "x" * 5000 + " sk_live_2"]
    spark.createDataFrame([(i, 2, "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "sk_live_1")], "n_nationkey bigint, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r.trace_id: r for r in judge_evidence(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        line = "Turn 1: sqlite.write_query(" + json.dumps({"n": t}, separators=(",", ":")) + ")"
        assert (got[f"{i}-2"].evidence_md5, got[f"{i}-2"].n_chars, got[f"{i}-2"].cut) == (hashlib.md5(line.encode()).hexdigest(), len(line), 0)
    assert got["0-2"].secrets_md5 == hashlib.md5(b"- 7: sk_live_1").hexdigest()
