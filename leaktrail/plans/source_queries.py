"""Readers and writers on logs derived from the tables: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.plans.rate_queries import V, verdicts
from leaktrail.plans.registry import query, table
from leaktrail.session import shared_dir
from leaktrail.sources import logs


def _folder(spark, name):
    return f"{shared_dir(spark)}/leaktrail/logs/{name}-{uuid.uuid4().hex}"


def _logged_turns(spark, sf_dir):
    """Conversation turns as one-event traces, some without events."""
    c = table(spark, sf_dir, "conversations")
    event = F.struct(F.col("turn").cast("int").alias("turn"), F.lit("memory").alias("server"), F.col("role").alias("tool"),
                     F.to_json(F.struct(F.substring("text", 1, 20).alias("note"))).alias("args"), F.col("text").alias("result_full"))
    tid = F.concat_ws("-", "conv_id", "turn")
    rows = c.select(tid.alias("trace_id"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.lit("risky_v1").alias("env_type"),
                    F.lit("first").alias("outcome"), F.when(F.col("turn") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("_e"), event.alias("_ev"))
    return rows.withColumn("events", F.transform("_e", lambda _: F.col("_ev"))).drop("_e", "_ev")


def _line_log(spark, sf_dir, path):
    """The traces as JSON lines, every third id written twice."""
    rows = _logged_turns(spark, sf_dir)
    rows.write.json(f"{path}/a")
    rows.filter(F.crc32("trace_id") % 3 == 0).withColumn("outcome", F.lit("second")).write.json(f"{path}/b")


@query("line_log_round_trip", "SRC-3, SRC-4, SNK-2, WIN-1", r"""SELECT conv_id || '-' || turn AS trace_id, 'm' || (conv_id % 3) AS model, role AS tool, CAST(0 AS BIGINT) AS idx, md5(text) AS result_md5
FROM conversations WHERE turn % 5 <> 4""")
def line_log_round_trip(spark, sf_dir):
    """JSON lines with repeats: empty traces dropped, one row per id, events exploded with their position."""
    path = _folder(spark, "lines")
    _line_log(spark, sf_dir, path)
    main, again = logs.read_lines(spark, f"{path}/a", "*.json"), logs.read_lines(spark, f"{path}/b", "*.json", ordered=True)
    events = logs.explode_events(logs.resume(main, again))
    return events.select("trace_id", "model", "tool", "idx", F.md5("result_full").alias("result_md5"))


_HEADER = {"schema_version": "3", "pipeline_git_commit": "abc", "task_taxonomy_version": "t2", "labeling_rules_version": "r1"}


@query("envelope_files", "SRC-1, SRC-2, SRC-3, SNK-1", r"""SELECT conv_id || '-' || turn AS trace_id, 'm' || (conv_id % 3) AS model, 'first' AS outcome, 'r1' AS labeling_rules_version, role AS tool, CAST(0 AS BIGINT) AS idx, md5(text) AS result_md5
FROM conversations WHERE turn % 5 <> 4
UNION ALL SELECT 'bare-' || conv_id || '-' || turn, 'm' || (conv_id % 3), 'first', NULL, role, 0, md5(text) FROM conversations WHERE turn % 5 <> 4 AND conv_id % 7 = 0""")
def envelope_files(spark, sf_dir):
    """Two directories of envelopes, the second with repeats, beside bare lists and a corrupt file: the first one wins per id."""
    path, rows = _folder(spark, "envelopes"), _logged_turns(spark, sf_dir)
    logs.write_envelopes(rows, f"{path}/a", _HEADER)
    logs.write_envelopes(rows.filter(F.crc32("trace_id") % 3 == 0).withColumn("outcome", F.lit("second")), f"{path}/b", _HEADER)
    bare = rows.filter(F.split_part("trace_id", F.lit("-"), F.lit(1)).cast("bigint") % 7 == 0).withColumn("trace_id", F.concat(F.lit("bare-"), "trace_id"))
    lists = bare.groupBy(F.pmod(F.xxhash64("trace_id"), F.lit(64))).agg(F.to_json(F.collect_list(F.struct(*bare.columns))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/c")
    spark.range(1).selectExpr("'{\"schema_version\": \"3\", \"traces\": [{\"trace_id\"' AS value").write.text(f"{path}/d")
    found = logs.load_traces(spark, [f"{path}/{k}" for k in "abcd"], pattern="part-*")
    kept = found.select("trace_id", "model", "outcome", "labeling_rules_version", F.posexplode("events").alias("idx", "e"))
    return kept.select("trace_id", "model", "outcome", "labeling_rules_version", "e.tool", F.col("idx").cast("bigint").alias("idx"),
                       F.md5("e.result_full").alias("result_md5"))


@query("arm_files", "SRC-5", r"""SELECT conv_id || '-' || turn AS trace_id, CASE conv_id % 2 WHEN 0 THEN 'none' ELSE 'taint_tracking' END AS defense, 'r1' AS labeling_rules_version,
  CAST(turn % 5 <> 4 AS INT) AS n_events FROM conversations""")
def arm_files(spark, sf_dir):
    """Two arms in directories of their own; each is read with the check that all its traces carry its defense."""
    path, rows = _folder(spark, "arms"), _logged_turns(spark, sf_dir).withColumn("mitigation_level", F.lit("none"))
    odd, arms = F.split_part("trace_id", F.lit("-"), F.lit(1)).cast("bigint") % 2, []
    for name, cond in (("none", odd == 0), ("taint_tracking", odd == 1)):
        logs.write_envelopes(rows.filter(cond).withColumn("defense", F.lit(name)), f"{path}/{name}", _HEADER)
        arms.append(logs.load_arm(spark, f"{path}/{name}", name, pattern="part-*"))
    return arms[0].unionByName(arms[1]).select("trace_id", "defense", "labeling_rules_version", F.size("events").alias("n_events"))


@query("appended_log", "SNK-2", "SELECT event_id, user_id, event_type FROM events")
def appended_log(spark, sf_dir):
    """Events streamed into an append-only log, started twice on one checkpoint: nothing is written again."""
    path = _folder(spark, "appended")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").select("event_id", "user_id", "event_type")
    for _ in range(2):
        logs.append_stream(rows, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).json(f"{path}/log")


@query("report_files", "SNK-4", "SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY ALL")
def report_files(spark, sf_dir):
    """A report under a name of its own; a second report under that name is refused and leaves the first."""
    path = _folder(spark, "report")
    report = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    logs.write_report(report, path)
    try:
        logs.write_report(report.limit(0), path)
    except AnalysisException as err:
        if "PATH_ALREADY_EXISTS" not in str(err):
            raise
    return spark.read.schema(report.schema).json(path)


@query("partitioned_log_round_trip", "SNK-1, SRC-2, SET-1", V + "SELECT model, env_class, count(*) AS n, 'r1' AS labeling_rules_version FROM verdicts WHERE model = 'model_1' AND env_class = 'risky' GROUP BY ALL")
def partitioned_log_round_trip(spark, sf_dir):
    """A versioned log partitioned by model and environment class; the filter prunes partitions."""
    path = _folder(spark, "parquet")
    logs.write_log(verdicts(spark, sf_dir).drop("env_class"), path, {"labeling_rules_version": "r1"})
    back = spark.read.parquet(path).filter("model = 'model_1' AND env_class = 'risky'")
    return back.groupBy("model", "env_class", "labeling_rules_version").agg(F.count(F.lit(1)).alias("n"))


@query("points_round_trip", "SNK-3, SNK-4", V + "SELECT model, mitigation_level, CAST(count(*) AS VARCHAR) AS n FROM verdicts GROUP BY ALL")
def points_round_trip(spark, sf_dir):
    path = _folder(spark, "csv")
    logs.write_points(verdicts(spark, sf_dir).groupBy("model", "mitigation_level").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("model string, mitigation_level string, n string").csv(path)


@query("annotation_sheet", "SRC-6", "SELECT CAST(doc_id AS VARCHAR) AS task_id, quality = 1 AS label FROM labels")
def annotation_sheet(spark, sf_dir):
    """Labels as an annotation sheet with mixed spellings, read with the fatal checks."""
    yes, no = F.array(*[F.lit(x) for x in v.TRUE_TOKENS]), F.array(*[F.lit(x.upper()) for x in v.FALSE_TOKENS])
    spelled = F.when(F.col("quality") == 1, F.element_at(yes, (F.col("doc_id") % 6 + 1).cast("int"))).otherwise(
        F.element_at(no, (F.col("doc_id") % 7 + 1).cast("int")))
    path = _folder(spark, "sheet")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("task_id"), F.lit("d").alias("description"), spelled.alias("your_crs_label"))
    rows.write.option("header", True).csv(path)
    return logs.read_sheet(spark, path)


@query("regression_table", "SRC-7, SRT-2", V + "SELECT model, mechanism, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(any_risk AS INT)) AS BIGINT) AS leaked FROM verdicts WHERE NOT completion_requires_secret GROUP BY ALL")
def regression_table(spark, sf_dir):
    path = _folder(spark, "regression")
    d = verdicts(spark, sf_dir)
    d.select("model", "task_id", "mechanism", F.col("env_type").alias("env_variant"), F.col("completion_requires_secret").cast("int").alias("is_crs"),
             F.col("any_risk").cast("int").alias("leaked"), F.col("artifact_verified").cast("int").alias("utility")).write.option("header", True).csv(path)
    return logs.read_regression(spark, path).groupBy("model", "mechanism").agg(F.count(F.lit(1)).alias("n"), F.sum("leaked").alias("leaked"))


@query("file_digests", "SRC-9")
def file_digests(spark, sf_dir):
    return logs.file_digests(spark, f"{sf_dir}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("sanitized_copy", "SNK-5, RED-4", """SELECT doc_id FROM documents WHERE doc_id % 4 = 0""")
def sanitized_copy(spark, sf_dir):
    """Only documents that a rule changed and that pass every check are copied."""
    mark = F.when(F.col("doc_id") % 4 == 0, F.lit(" /Users/someone/notes")).otherwise(F.lit(""))
    raw = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", mark).alias("text"))
    path = _folder(spark, "clean")
    logs.write_sanitized(raw, "doc_id", "text", ["lang"], path)
    return spark.read.parquet(path).select("doc_id")


def _turn_traces(spark, sf_dir):
    """Conversation turns as nested traces of three events each."""
    c = table(spark, sf_dir, "conversations")
    servers = [("filesystem", "read_file"), ("sqlite", "write_query"), ("sqlite", "read_query")]
    events = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(s).alias("server"), F.lit(t).alias("tool"),
                                F.to_json(F.struct(F.col("text").alias("n"))).alias("args"), F.col("text").alias("result_full"))
                       for i, (s, t) in enumerate(servers)])
    kept = F.slice(events, 1, (F.col("turn") % 4).cast("int"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("trace_id"), F.concat(F.lit("task"), F.col("conv_id") % 9).alias("task_id"), kept.alias("events"),
                    F.when(F.col("conv_id") % 2 == 0, "risky_v1").otherwise("benign").alias("env_type"), F.col("role").alias("model"),
                    (F.col("turn") % 3).cast("int").alias("tool_errors"), F.length("text"))


@query("feature_rows", "PRJ-27, WIN-4", """SELECT conv_id || '-' || turn AS trace_id, turn % 4 AS n_events, CASE WHEN turn % 4 >= 2 THEN 1 ELSE 0 END AS n_writes,
  CAST(CASE turn % 4 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS cross_server_ratio, CAST(turn % 3 AS DOUBLE) / greatest(turn % 4, 1) AS tool_error_rate,
  'task' || (conv_id % 9) || '::' || (CASE WHEN conv_id % 2 = 0 THEN 'risky' ELSE 'benign' END) || '::' || role AS group_id, 'safe_failure' AS outcome FROM conversations""")
def feature_rows(spark, sf_dir):
    from leaktrail import schema
    from leaktrail.operators.features import feature_rows as build

    # the full trace schema, with what the table cannot provide left empty
    full = F.from_json(F.to_json(F.struct("*")), schema.TRACE)
    traces = _turn_traces(spark, sf_dir).drop("length(text)").select(full.alias("t")).select("t.*")
    return build(traces).select("trace_id", "n_events", "n_writes", "cross_server_ratio", "tool_error_rate", "group_id", "outcome")


def _nation_scope(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.lit("risky_v1").alias("env_type"), F.col("n_nationkey").alias("canary_id"), F.col("n_name").alias("value"))


@query("judge_evidence", "JDG-1, PRJ-31", """SELECT conv_id || '-' || turn AS trace_id, md5(text) AS evidence_md5, length(text) AS n_chars, 0 AS cut, md5(secret_list) AS secrets_md5 FROM (
  SELECT conv_id, turn, CASE WHEN turn % 4 >= 2 THEN 'Turn 1: sqlite.write_query(' || CAST(json_object('n', text) AS VARCHAR) || ')' ELSE '(no outbound-channel operations)' END AS text,
    CASE WHEN conv_id % 2 = 0 THEN (SELECT string_agg('- ' || n_nationkey || ': ' || n_name, chr(10) ORDER BY '- ' || n_nationkey || ': ' || n_name) FROM nation)
    ELSE '(no sensitive values in this environment)' END AS secret_list FROM conversations)""")
def judge_evidence(spark, sf_dir):
    """Digests of the whole evidence, arguments uncut, and of the secrets in scope."""
    from leaktrail.operators import judged

    inputs = judged.judge_inputs(judged.evidence_text(_turn_traces(spark, sf_dir)), _nation_scope(spark, sf_dir))
    return inputs.select("trace_id", F.md5("evidence_text").alias("evidence_md5"), F.length("evidence_text").alias("n_chars"),
                         F.col("n_truncated_events").alias("cut"), F.md5("secret_list").alias("secrets_md5"))


@query("judge_inputs", "JDG-1, PRJ-31", """SELECT conv_id || '-' || turn AS trace_id, CASE WHEN turn % 4 >= 2 THEN 'Turn 1: sqlite.write_query(' ELSE '(no outbound-channel operations)' END AS head,
  CASE WHEN turn % 4 >= 2 THEN 1 ELSE 0 END AS cut, CASE WHEN conv_id % 2 = 0 THEN (SELECT count(*) FROM nation) ELSE 1 END AS n_secrets FROM conversations""")
def judge_inputs(spark, sf_dir):
    """The capped form (two characters of arguments) with the secrets in scope; ``judge_evidence`` has the whole evidence."""
    from leaktrail.operators import judged

    inputs = judged.judge_inputs(judged.evidence_text(_turn_traces(spark, sf_dir), cap=2), _nation_scope(spark, sf_dir))
    head = F.when(F.col("evidence_text").startswith("Turn"), F.substring("evidence_text", 1, 27)).otherwise(F.col("evidence_text"))
    return inputs.select("trace_id", head.alias("head"), F.col("n_truncated_events").alias("cut"), F.size(F.split("secret_list", "\n")).cast("long").alias("n_secrets"))
