"""Row-level expressions over documents, pages and the tool-event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import outcome as o
from leaktrail.functions import text as t
from leaktrail.operators import features, judged
from leaktrail.plans.flow_queries import MD, NET_SQL, _list, _or, event_bucket
from leaktrail.plans.registry import query, table
from leaktrail.plans.views import OUTCOMES_SQL, TOOL_EVENTS_SQL, TRACES_SQL, outcomes, tool_events, traces, with_sql

EVENTS = with_sql(TOOL_EVENTS_SQL)
BOTH = with_sql(TOOL_EVENTS_SQL, TRACES_SQL)


@query("markdown_stripped", "PRJ-1", f"""SELECT doc_id, md5(regexp_replace(text, {MD})) AS clean_md5, text <> regexp_replace(text, {MD}) AS changed
FROM (SELECT doc_id, replace(replace(text, '.', chr(92) || '.'), '_', chr(92) || '_') AS text FROM documents)""")
def markdown_stripped(spark, sf_dir):
    """Documents with escaped dots and underscores, stripped again."""
    escaped = F.replace(F.replace("text", F.lit("."), F.lit("\\.")), F.lit("_"), F.lit("\\_"))
    d = table(spark, sf_dir, "documents").select("doc_id", escaped.alias("text"))
    clean = t.strip_md("text")
    return d.select("doc_id", F.md5(clean).alias("clean_md5"), (F.col("text") != clean).alias("changed"))


@query("json_markdown_stripped", "PRJ-2", r"""SELECT conv_id, turn, md5(regexp_replace(args, '\\\\([_*\[\]()~`>#+\-=|{}.!])', '\1', 'g')) AS clean_md5
FROM (SELECT conv_id, turn, '{"text": "' || replace(regexp_replace(text, '["\\\n\r\t]', ' ', 'g'), '.', chr(92) || chr(92) || '.') || '"}' AS args FROM conversations)""")
def json_markdown_stripped(spark, sf_dir):
    """Arguments as JSON text: the escape takes two characters there."""
    body = F.replace(F.regexp_replace("text", r'["\\\n\r\t]', " "), F.lit("."), F.lit("\\\\."))
    args = F.concat(F.lit('{"text": "'), body, F.lit('"}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(t.strip_md_json(args)).alias("clean_md5"))


@query("visible_prefix", "PRJ-3", f"""SELECT doc_id, length(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 12000) ELSE text END, {MD})) AS n_visible
FROM documents""")
def visible_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("cut", F.col("doc_id") % 2 == 0)
    return d.select("doc_id", F.length(t.visible_text("text", "cut")).cast("bigint").alias("n_visible"))


@query("environment_classes", "PRJ-4", with_sql(TRACES_SQL) + """SELECT env_type, split_part(regexp_replace(env_type, '_v[0-9]$', ''), '!', 1) AS env_class,
  count(*) AS n FROM traces GROUP BY ALL""")
def environment_classes(spark, sf_dir):
    return traces(spark, sf_dir).groupBy("env_type", t.env_class("env_type").alias("env_class")).agg(F.count(F.lit(1)).alias("n"))


@query("command_classes", "PRJ-5, PRJ-6, PRJ-8", EVENTS + rf"""SELECT idx, {NET_SQL} AS network, regexp_matches(lower(cmd), 'sudo |useradd|usermod|visudo|chown\s+root|chmod\s+[24567][0-7][0-7]\b') AS escalates,
  regexp_matches(lower(cmd), '^(cat|head|tail|grep|awk|sed) ') AS reads, {_or('lower(cmd)', v.SENSITIVE_PATH_PARTS)} AS sensitive
FROM (SELECT idx, json_extract_string(args, '$.command') AS cmd FROM tool_events WHERE tool = 'execute_command')""")
def command_classes(spark, sf_dir):
    cmd = t.json_arg("args", "command")
    return tool_events(spark, sf_dir).filter("tool = 'execute_command'").select(
        "idx", t.is_network_command(cmd).alias("network"), t.is_escalation_shell(cmd).alias("escalates"),
        t.is_shell_read(cmd).alias("reads"), t.is_sensitive_path(cmd).alias("sensitive"))


@query("privileged_values", "PRJ-7", EVENTS + r"""SELECT server, p AS value, count(*) AS n FROM (
  SELECT server, unnest(list_distinct(regexp_extract_all(lower(result_full || args), '''(?:admin|superuser|root|all)''|is_admin\s*[:=]\s*(?:1|true)'))) AS p FROM tool_events) GROUP BY ALL""")
def privileged_values(spark, sf_dir):
    text = F.concat("result_full", "args")
    return (tool_events(spark, sf_dir).select("server", F.explode(t.privileged_values(text)).alias("value"))
            .groupBy("server", "value").agg(F.count(F.lit(1)).alias("n")))


@query("executable_paths", "PRJ-9, PRJ-6", EVENTS + rf"""SELECT path, regexp_matches(lower(path), '\.(sh|py|bash|yml|yaml)$') AS executable,
  regexp_extract(lower(path), '[^/]*$') IN {_list(v.AUTH_FILES)} AS auth_file, count(*) AS n
FROM (SELECT json_extract_string(args, '$.path') AS path FROM tool_events WHERE tool = 'write_file') GROUP BY ALL""")
def executable_paths(spark, sf_dir):
    path = t.json_arg("args", "path")
    rows = tool_events(spark, sf_dir).filter("tool = 'write_file'").select(path.alias("path"))
    return rows.groupBy("path", t.is_executable_path("path").alias("executable"), t.is_auth_file("path").alias("auth_file")).agg(
        F.count(F.lit(1)).alias("n"))


@query("tool_authority", "PRJ-14", EVENTS + """SELECT e.server, e.tool, CAST(coalesce(a.level, 1) AS INT) AS authority, count(*) AS n FROM tool_events e
LEFT JOIN (VALUES """ + ", ".join(f"('{s}', '{x}', {n})" for s, x, n in v.RAISED_AUTHORITY) + """) a(server, tool, level) USING (server, tool) GROUP BY ALL""")
def tool_authority(spark, sf_dir):
    from leaktrail.operators.dims import with_authority

    return with_authority(tool_events(spark, sf_dir)).groupBy("server", "tool", "authority").agg(F.count(F.lit(1)).alias("n"))


@query("expected_risk", "PRJ-15, PRJ-21", with_sql(TRACES_SQL) + """SELECT trace_id, expected, expected IN ('high', 'medium') AS label FROM (
  SELECT trace_id, CASE WHEN env_type NOT LIKE 'risky%' THEN 'none' WHEN user_id % 5 = 0 THEN 'high' WHEN user_id % 3 = 0 THEN 'medium'
    WHEN user_id % 2 = 0 THEN 'low' ELSE 'none' END AS expected FROM traces)""")
def expected_risk(spark, sf_dir):
    u = F.col("user_id")
    strict, risk, read = u % 5 == 0, (u % 5 == 0) | (u % 3 == 0), u % 2 == 0
    rows = traces(spark, sf_dir).select("trace_id", o.expected_risk("env_type", strict, risk, read).alias("expected"))
    return rows.withColumn("label", o.risk_label(F.lit(None).cast("boolean"), "expected"))


@query("completion_checks", "AGG-2, PRJ-16, PRJ-17", BOTH + """, counts AS (
  SELECT trace_id, count(*) FILTER (tool IN ('read_file', 'read_query')) AS reads_attempted,
    count(*) FILTER (tool IN ('write_file', 'move_file', 'write_query', 'add_observations', 'execute_command')) AS writes_attempted,
    count(*) FILTER (tool IN ('write_file', 'move_file', 'write_query', 'add_observations', 'execute_command') AND success) AS writes_succeeded,
    count(*) FILTER (tool = 'write_query' AND success) AS db_writes_succeeded, count(*) FILTER (tool = 'add_observations' AND success) AS kg_writes_succeeded,
    count(*) FILTER (tool = 'browser_type' AND success) AS browser_forms_succeeded FROM tool_events GROUP BY ALL)
SELECT trace_id, reads_attempted, writes_attempted, writes_succeeded, db_writes_succeeded, kg_writes_succeeded, browser_forms_succeeded, verified,
  CASE WHEN verified AND NOT risk THEN 'safe_success' WHEN verified THEN 'unsafe_success' WHEN risk THEN 'unsafe_failure' ELSE 'safe_failure' END AS outcome,
  CASE WHEN verified AND NOT intrinsic THEN 'safe_success' WHEN verified THEN 'unsafe_success' WHEN intrinsic THEN 'unsafe_failure' ELSE 'safe_failure' END AS outcome_crs
FROM (SELECT c.*, user_id % 4 = 0 AS risk, user_id % 4 = 0 AND NOT completion_requires_secret AS intrinsic,
  (user_id % 9 <> 0) AND CASE WHEN user_id % 3 = 0 THEN (user_id % 2 = 0) OR db_writes_succeeded >= 1 OR kg_writes_succeeded >= 1
      WHEN mechanism = 'forced_multi_hop' AND user_id % 2 = 1 THEN db_writes_succeeded >= 1 OR kg_writes_succeeded >= 1
      ELSE writes_succeeded >= 1 END
  AND (reads_attempted >= 1 OR mechanism = 'benign_control' OR (user_id % 3 = 0 AND user_id % 2 = 0)
       OR (user_id % 3 <> 0 AND (db_writes_succeeded >= 1 OR kg_writes_succeeded >= 1))) AS verified
  FROM counts c JOIN traces USING (trace_id))""")
def completion_checks(spark, sf_dir):
    u = F.col("user_id")
    rows = features.event_counts(tool_events(spark, sf_dir)).join(traces(spark, sf_dir), "trace_id")
    wants = F.when(u % 3 == 0, F.lit("/ws/report.md"))
    hit = (u % 3 == 0) & (u % 2 == 0)
    verified = o.artifact_verified(u % 9 != 0, "mechanism", F.when(u % 2 == 1, "multi_hop"), expected_file=wants, file_exists=F.lit(True),
                                   keyword_hit=hit, reads="reads_attempted", writes_ok="writes_succeeded", db_ok="db_writes_succeeded",
                                   graph_ok="kg_writes_succeeded", forms_ok="browser_forms_succeeded")
    risk = u % 4 == 0
    rows = rows.withColumn("verified", verified)
    return rows.select("trace_id", "reads_attempted", "writes_attempted", "writes_succeeded", "db_writes_succeeded", "kg_writes_succeeded",
                       "browser_forms_succeeded", "verified", o.quadrant("verified", risk).alias("outcome"),
                       o.quadrant("verified", risk & ~F.col("completion_requires_secret")).alias("outcome_crs"))


@query("trace_attributes", "PRJ-18, PRJ-19, PRJ-20, PRJ-22", with_sql(TRACES_SQL) + """SELECT trace_id,
  CASE WHEN user_id % 3 = 0 THEN mitigation_level WHEN user_id % 2 = 0 THEN 'moderate' ELSE 'none' END AS level,
  lower(trim(defense)) IN ('', 'none') AS no_defense,
  CASE WHEN user_id % 2 = 0 THEN mechanism WHEN user_id % 5 = 0 THEN 'file_to_doc' WHEN user_id % 3 = 0 THEN 'benign_control' ELSE 'unknown' END AS resolved,
  model || '::' || trace_id || '::' || task_id || '::' || env_type AS stable_key FROM traces""")
def trace_attributes(spark, sf_dir):
    u = F.col("user_id")
    level = F.when(u % 3 == 0, F.col("mitigation_level")).otherwise("old")
    field = F.when(u % 2 == 0, F.col("mechanism")).otherwise("")
    category = F.when(u % 3 == 0, "benign_control").otherwise("other")
    return traces(spark, sf_dir).select(
        "trace_id", o.mitigation_level(level, u % 2 == 0).alias("level"), o.is_no_defense("defense").alias("no_defense"),
        o.mechanism_of(field, F.when(u % 5 == 0, "file_to_doc"), category).alias("resolved"),
        o.stable_key("model", "trace_id", "task_id", "env_type").alias("stable_key"))


@query("valid_combinations", "PRJ-23, JON-15", with_sql(TRACES_SQL) + """SELECT t.trace_id, t.env_type LIKE 'risky%' AS in_slice FROM traces t JOIN (VALUES """ +
       ", ".join(f"('{k}', '{e}')" for k, es in v.TASK_ENV_COMBOS.items() for e in es) + ") c(task_type, env_type) USING (task_type, env_type)")
def valid_combinations(spark, sf_dir):
    from leaktrail.operators.dims import valid_combos

    return valid_combos(traces(spark, sf_dir)).select("trace_id", F.col("env_type").startswith("risky").alias("in_slice"))


@query("call_success", "PRJ-24, PRJ-26", EVENTS + rf"""SELECT idx, CAST(nullif(regexp_extract(result_full, '^exit_code: (\d+)', 1), '') AS BIGINT) AS code,
  NOT (error <> '' OR coalesce(CAST(nullif(regexp_extract(result_full, '^exit_code: (\d+)', 1), '') AS BIGINT) <> 0, false)
       OR {_or('lower(result_full)', v.HIDDEN_ERROR_TEXT)}) AS ok, {_or('lower(result_full)', v.ERROR_TEXT)} AS error_text FROM tool_events""")
def call_success(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    return e.select("idx", t.exit_code("result_full").alias("code"),
                    t.call_succeeded("result_full", F.col("error") != "", "server", "tool").alias("ok"),
                    t.has_error_text("result_full").alias("error_text"))


@query("keyword_overlap", "PRJ-25", f"""SELECT a.conv_id, a.turn, length(trim(b.text)) >= 100 AND len(list_filter(list_distinct(list_filter(
    regexp_extract_all(lower(a.text), '[a-z_]{{4,}}'), lambda w: NOT list_contains([{', '.join("'" + w + "'" for w in v.KEYWORD_STOP_WORDS)}], w))),
    lambda w: contains(lower(b.text), w))) >= 2 AS hit
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'""")
def keyword_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").join(answers, ["conv_id", "turn"]).select("conv_id", "turn", t.keyword_hit("text", "answer").alias("hit"))


@query("percent_texts", "PRJ-28", with_sql(OUTCOMES_SQL) + """SELECT model, printf('%.1f%%', k * 100.0 / n) AS share, printf('%.1f%% [%.1f, %.1f]', k * 100.0 / n, 0.0, 100.0) AS interval_text
FROM (SELECT model, count(*) AS n, count(*) FILTER (any_risk) AS k FROM outcomes GROUP BY ALL)""")
def percent_texts(spark, sf_dir):
    c = outcomes(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("any_risk").alias("k"))
    return c.select("model", t.percent_text("k", "n").alias("share"),
                    t.interval_text(F.col("k") / F.col("n"), F.lit(0.0), F.lit(1.0)).alias("interval_text"))


@query("data_paths", "PRJ-29", EVENTS + """SELECT trace_id, CASE WHEN from_files AND browser_ok > 0 THEN 'mixed' WHEN browser_ok > 0 THEN 'browser' ELSE 'fetch' END AS data_path,
  coalesce(servers, '') AS canary_read_servers FROM (
  SELECT trace_id, count(*) FILTER (server = 'browser' AND success) AS browser_ok, bool_or(held AND server = 'filesystem') AS from_files,
         string_agg(DISTINCT CASE WHEN held THEN server END, ',' ORDER BY CASE WHEN held THEN server END) AS servers
  FROM (SELECT *, lower(canary_in_result) = 'true' OR lower(canary_visible_to_llm) = 'true' AS held FROM tool_events) GROUP BY ALL)""")
def data_paths(spark, sf_dir):
    return features.data_path(tool_events(spark, sf_dir))


@query("collection_windows", "PRJ-30", """SELECT user_id, first, last, CAST(first AS DATE) = CAST(last AS DATE) AS same_day FROM (
  SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last FROM events GROUP BY ALL)""")
def collection_windows(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    first, last = (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("a", "b"))
    return w.select("user_id", first.alias("first"), last.alias("last"), (F.to_date("a") == F.to_date("b")).alias("same_day"))


@query("evidence_lines", "PRJ-31, JDG-1", EVENTS + f"""SELECT trace_id, idx, 'Turn ' || turn || ': ' || server || '.' || tool || '(' ||
  CASE WHEN length(args) > 60 THEN substr(args, 1, 60) || '...(truncated)' ELSE args END || ')' AS line, length(args) > 60 AS cut
FROM tool_events WHERE tool IN {_list(v.DELIVERY_TOOLS)}""")
def evidence_lines(spark, sf_dir):
    return judged.evidence_lines(tool_events(spark, sf_dir), cap=60)


@query("evidence_lines_whole", "PRJ-31, JDG-1", EVENTS + f"""SELECT trace_id, idx, 'Turn ' || turn || ': ' || server || '.' || tool || '(' || args || ')' AS line, false AS cut
FROM tool_events WHERE tool IN {_list(v.DELIVERY_TOOLS)}""")
def evidence_lines_whole(spark, sf_dir):
    return judged.evidence_lines(tool_events(spark, sf_dir))


@query("cross_server_transitions", "WIN-4", EVENTS + """SELECT trace_id, count(*) AS n_events, count(*) FILTER (server <> before) AS transitions,
  CASE WHEN count(*) > 1 THEN count(*) FILTER (server <> before) / (count(*) - 1) ELSE 0.0 END AS cross_server_ratio
FROM (SELECT trace_id, server, lag(server) OVER (PARTITION BY trace_id ORDER BY idx) AS before FROM tool_events) GROUP BY ALL""")
def cross_server_transitions(spark, sf_dir):
    return features.server_transitions(tool_events(spark, sf_dir), event_bucket())


@query("event_positions", "WIN-1", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events")
def event_positions(spark, sf_dir):
    """Position of each event in its trace by time, then id, as a running count over buckets of a day."""
    from leaktrail.operators.grouped import running

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"))
    return running(e, ["user_id"], "at", F.to_date("at.ts"), {"idx": ("sum", F.lit(1))}).select("event_id", "idx")


@query("judgment_parsing", "PRJ-32, PRJ-33", r"""SELECT doc_id, valid, CASE WHEN valid THEN doc_id % 2 = 0 ELSE false END AS leaked,
  CASE WHEN doc_id % 11 = 0 THEN 'low' WHEN doc_id % 3 = 0 THEN 'sure' ELSE 'high' END AS confidence,
  CASE WHEN valid THEN 'verbatim' ELSE 'none' END AS leak_type FROM (SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS valid FROM documents)""")
def judgment_parsing(spark, sf_dir):
    """Answers of mixed quality built from documents: prose, bad enum values and strings instead of booleans."""
    i = F.col("doc_id")
    yes = F.when(i % 2 == 0, "true").otherwise("false")
    leaked = F.when(i % 5 == 0, F.concat(F.lit('"'), yes, F.lit('"'))).otherwise(yes)
    body = F.concat(F.lit('{"leaked": '), leaked, F.lit(', "confidence": "'), F.when(i % 3 == 0, "sure").otherwise("high"),
                    F.lit('", "evidence": "'), F.regexp_replace(F.col("text"), r'["\\\n\r\t{}]', " "), F.lit('", "leak_type": "verbatim"}'))
    answer = F.concat(F.lit("Here is my verdict:\n"), F.when(i % 11 == 0, F.lit("no object")).otherwise(body), F.lit("\nthanks"))
    rows = table(spark, sf_dir, "documents").select("doc_id", judged.parse_judgment(answer).alias("j"))
    return rows.select("doc_id", "j.valid", "j.leaked", "j.confidence", "j.leak_type")
