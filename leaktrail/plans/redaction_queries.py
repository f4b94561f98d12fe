"""Redaction, release checks, extracted secrets and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaktrail.operators import redaction as red
from leaktrail.operators import regress
from leaktrail.plans.flow_queries import BASE, LABELS, _labels
from leaktrail.plans.registry import query, spread, table
from leaktrail.plans.views import OUTCOMES_SQL, outcomes, secret_dictionary, tool_events, with_sql

#: documents with the traces a collection machine leaves behind
_RAW = r"""raw AS (SELECT doc_id, source, lang, text || ' C:\\Users\\Administrator\\f' || doc_id || ' /Users/u' || (doc_id % 7) || '/x USERNAME=Administrator COMPUTERNAME=DESKTOP-' || (doc_id % 5)
  || ' drwx Administrator 197121 System Administrators "judge_api_base": "https://h' || (doc_id % 3) || '.example/v1" http://gw.example/a MODEL_BASE_URL=https://in.example/v1 OTHER_BASE_URL=https://out.example/v1 INIT_CWD=/opt/build/x' AS text FROM documents)"""


def _raw(spark, sf_dir):
    i = F.col("doc_id")
    tail = [F.lit(" C:\\\\Users\\\\Administrator\\\\f"), i, F.lit(" /Users/u"), i % 7, F.lit("/x USERNAME=Administrator COMPUTERNAME=DESKTOP-"), i % 5,
            F.lit(' drwx Administrator 197121 System Administrators "judge_api_base": "https://h'), i % 3, F.lit('.example/v1" http://gw.example/a MODEL_BASE_URL=https://in.example/v1 OTHER_BASE_URL=https://out.example/v1 INIT_CWD=/opt/build/x')]
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", "lang", F.concat("text", *[x.cast("string") for x in tail]).alias("text"))


def _duck(pattern: str, repl: str) -> tuple[str, str]:
    return pattern.replace("'", "''"), repl.replace("$1", r"\1").replace("$2", r"\2")


HOST_RULES = red.RULES + red.variable_rules(["MODEL_BASE_URL"], ["INIT_CWD"]) + red.host_rules("gw.example")


def _chain(column: str, rules) -> str:
    for _, p, r in rules:
        pattern, repl = _duck(p.replace(r"\Qgw.example\E", r"gw\.example"), r)
        column = f"regexp_replace({column}, '{pattern}', '{repl}', 'g')"
    return column


@query("redacted_documents", "RED-1, RED-2, RED-3", f"WITH {_RAW} SELECT doc_id, md5(clean) AS clean_md5, clean <> text AS changed FROM (SELECT *, {_chain('text', HOST_RULES)} AS clean FROM raw)")
def redacted_documents(spark, sf_dir):
    return red.clean(_raw(spark, sf_dir), "text", HOST_RULES).select("doc_id", F.md5("clean").alias("clean_md5"), "changed")


@query("redaction_counts", "RED-3", f"WITH {_RAW} " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(sum(len(regexp_extract_all(text, '{_duck(p, '')[0]}'))) AS BIGINT) AS matches FROM raw" for n, p, _ in red.RULES))
def redaction_counts(spark, sf_dir):
    return red.rule_counts(_raw(spark, sf_dir), "text")


@query("release_violations", "RED-4", f"""WITH {_RAW}, done AS (SELECT *, {_chain('text', red.RULES[2:])} AS clean FROM raw), probs AS (
  SELECT doc_id, 'residue_home_path' AS problem FROM done WHERE contains(clean, '/Users/') AND doc_id % 10 <> 3
  UNION ALL SELECT doc_id, 'residue_windows_user_path' FROM done WHERE regexp_matches(clean, '(?:\\\\{{2,4}}|/)Users(?:\\\\{{2,4}}|/)Administrator') AND doc_id % 10 <> 3
  UNION ALL SELECT doc_id, 'row_count' FROM done WHERE doc_id % 10 = 3
  UNION ALL SELECT doc_id, 'changed_lang' FROM done WHERE doc_id % 10 = 4)
SELECT * FROM probs""".replace("{{", "{").replace("}}", "}"))
def release_violations(spark, sf_dir):
    """A cleaned copy with two rules missing, lost rows and an altered field: every defect must be found."""
    raw = _raw(spark, sf_dir)
    done = red.clean(raw, "text", red.RULES[2:]).filter("doc_id % 10 <> 3")
    done = done.withColumn("lang", F.when(F.col("doc_id") % 10 == 4, "??").otherwise(F.col("lang")))
    return red.release_violations(raw, done, "doc_id", ["source", "lang"])


@query("known_secret_redaction", "RED-5", BASE + """SELECT idx, replace(replace(result_full, s.value, '<REDACTED:taint_blocked>'), s.core, '<REDACTED:taint_blocked>') AS clean
FROM tool_events e JOIN secrets s ON e.env_type = s.env_type AND e.k = s.canary_id""")
def known_secret_redaction(spark, sf_dir):
    e = tool_events(spark, sf_dir).select("idx", "env_type", F.col("k").alias("canary_id"), "result_full")
    pairs = e.join(secret_dictionary(spark, sf_dir).select("env_type", "canary_id", "value", "core"), ["env_type", "canary_id"])
    return pairs.select("idx", red.redact_known("result_full", F.array("value"), F.array("core")).alias("clean"))


@query("tokens_across_sources", "JON-4 on documents (V3)", """WITH t AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1))) AS token FROM documents)
SELECT token, count(*) AS n_docs, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc FROM t GROUP BY ALL""")
def tokens_across_sources(spark, sf_dir):
    """Tokens found in documents and how far each spread; every (token, source) is counted before the sources are."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1)))
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", F.explode(tokens).alias("token"))
    per_source = rows.groupBy("token", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d"))
    return per_source.groupBy("token").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"), F.min("d").alias("first_doc"))


@query("one_factor_likelihoods", "STA-18", with_sql(OUTCOMES_SQL) + """, c AS (SELECT mechanism, model, count(*) AS n, count(*) FILTER (any_risk) AS k FROM outcomes GROUP BY ALL),
g AS (SELECT 'null' AS fit, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k FROM c UNION ALL SELECT 'mechanism', sum(n), sum(k) FROM c GROUP BY mechanism UNION ALL SELECT 'model', sum(n), sum(k) FROM c GROUP BY model)
SELECT fit AS model, round(sum(CASE WHEN k > 0 THEN k * ln(k / n) ELSE 0 END + CASE WHEN n > k THEN (n - k) * ln((n - k) / n) ELSE 0 END), 6) AS log_likelihood FROM g GROUP BY fit""")
def one_factor_likelihoods(spark, sf_dir):
    cells = regress.cell_counts(outcomes(spark, sf_dir), ["mechanism", "model"], F.col("any_risk"))
    return regress.one_factor_likelihoods(cells, ["mechanism", "model"]).withColumn("log_likelihood", F.round("log_likelihood", 6))


def _bounded_models(spark, sf_dir):
    """Outcomes with the sources folded into five models, so that no cell is free of leaks."""
    return outcomes(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), F.substring("model", 4, 9).cast("int") % 5))


@query("deviance_shares", "STA-18")
def deviance_shares(spark, sf_dir):
    return regress.deviance_shares(_bounded_models(spark, sf_dir), "mechanism", "model", F.col("any_risk"))


@query("clustered_logit", "STA-19")
def clustered_logit(spark, sf_dir):
    d = _bounded_models(spark, sf_dir).withColumn("task", F.col("doc_id") % 60)
    return regress.clustered_logit(d, {"mechanism": "en", "model": "m0"}, "task", F.col("any_risk"))


@query("risk_labels_and_outcomes", "SIG-12, PRJ-15, PRJ-17, AGG-3", LABELS + """SELECT env_type, count(*) AS n, count(*) FILTER (any_risk) AS n_risk, count(*) FILTER (intrinsic_risk) AS n_intrinsic,
  count(*) FILTER (env_type LIKE 'risky%' AND strict_leakage) AS n_high, CAST(sum(signals_fired) AS BIGINT) AS signals FROM labels_of GROUP BY ALL""")
def risk_labels_and_outcomes(spark, sf_dir):
    from leaktrail.functions.outcome import expected_risk

    d = _labels(spark, sf_dir).withColumn("level", expected_risk("env_type", "strict_leakage", "any_risk", "sensitive_data_read"))
    return d.groupBy("env_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("any_risk").alias("n_risk"), F.count_if("intrinsic_risk").alias("n_intrinsic"),
        F.count_if(F.col("level") == "high").alias("n_high"), F.sum("signals_fired").alias("signals"))
