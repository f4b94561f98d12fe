"""Judged samples: evidence texts, judgment attempts, miss prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import text as t
from leaktrail.functions.stats import hypergeometric_interval, rate, wilson

JUDGMENT = "struct<leaked:string,confidence:string,evidence:string,leak_type:string>"


def evidence_lines(events: DataFrame, cap: int = 0) -> DataFrame:
    """One line per outbound call, in order, optionally capped."""
    args = F.coalesce("args", F.lit("{}"))
    too_long = (F.lit(cap) > 0) & (F.length(args) > cap)
    shown = F.when(too_long, F.concat(F.substring(args, 1, max(cap, 1)), F.lit("...(truncated)"))).otherwise(args)
    line = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(": "), "server", F.lit("."), "tool", F.lit("("), shown, F.lit(")"))
    return events.filter(F.col("tool").isin(v.DELIVERY_TOOLS)).select("trace_id", "idx", line.alias("line"), too_long.alias("cut"))


def evidence_text(traces: DataFrame, cap: int = 0) -> DataFrame:
    """Evidence of nested traces as one text, built inside the row from its own event array."""
    def line(e):
        args = F.coalesce(e["args"], F.lit("{}"))
        shown = F.when((F.lit(cap) > 0) & (F.length(args) > cap),
                       F.concat(F.substring(args, 1, max(cap, 1)), F.lit("...(truncated)"))).otherwise(args)
        return F.concat(F.lit("Turn "), e["turn"].cast("string"), F.lit(": "), e["server"], F.lit("."), e["tool"], F.lit("("), shown, F.lit(")"))

    out = F.filter("events", lambda e: e["tool"].isin(v.DELIVERY_TOOLS))
    cut = F.size(F.filter(out, lambda e: (F.lit(cap) > 0) & (F.length(F.coalesce(e["args"], F.lit("{}"))) > cap)))
    text = F.when(F.size(out) > 0, F.array_join(F.transform(out, line), "\n")).otherwise("(no outbound-channel operations)")
    return traces.withColumn("evidence_text", text).withColumn("n_truncated_events", cut)


def judge_inputs(sample: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sampled trace, evidence and the secrets in scope (small per environment)."""
    scope = dictionary.groupBy("env_type").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("- "), F.col("canary_id").cast("string"), F.lit(": "), "value"))), "\n").alias("secret_list"))
    return sample.join(scope, "env_type", "left").withColumn(
        "secret_list", F.coalesce("secret_list", F.lit("(no sensitive values in this environment)")))


def parse_judgment(raw) -> Column:
    """Struct of a judge's answer: valid only with a real boolean and known enum values."""
    body = t.first_json_object(raw)
    j = F.from_json(body, JUDGMENT)
    real_bool = F.regexp_like(body, F.lit(r'"leaked"\s*:\s*(true|false)\b'))
    errors = F.concat_ws("; ", F.when(~F.coalesce(real_bool, F.lit(False)), "leaked not bool"),
                         F.when(~F.coalesce(j["confidence"].isin(v.CONFIDENCES), F.lit(False)), "confidence invalid"),
                         F.when(~F.coalesce(j["leak_type"].isin(v.LEAK_TYPES), F.lit(False)), "leak_type invalid"))
    parse_error = body.isNull() | F.try_parse_json(body).isNull()
    valid = ~parse_error & (errors == "")
    return F.struct(
        valid.alias("valid"), (valid & (j["leaked"] == "true")).alias("leaked"),
        F.coalesce(F.when(~parse_error, j["confidence"]), F.lit("low")).alias("confidence"),
        F.when(valid, j["leak_type"]).otherwise("none").alias("leak_type"),
        F.when(parse_error, "parse_error").when(errors != "", F.concat(F.lit("schema_error: "), errors)).alias("error"))


def merge_attempts(attempts: DataFrame) -> DataFrame:
    """First valid attempt of a sample key wins, else the last one; counts and tokens are kept."""
    order = F.struct((~F.col("valid")).alias("bad"), F.when(F.col("valid"), F.col("attempt")).otherwise(-F.col("attempt")).alias("n"))
    tokens = [c for c in ("prompt_tokens", "completion_tokens", "total_tokens") if c in attempts.columns]
    out = attempts.groupBy("sample_key").agg(
        F.min_by(F.struct("leaked", "valid", "confidence", "leak_type", "truncated"), order).alias("j"),
        F.count(F.lit(1)).alias("judge_attempts"), *[F.sum(c).alias(c) for c in tokens])
    return out.select("sample_key", "j.*", "judge_attempts", *tokens,
                      ((F.col("judge_attempts") > 1) & F.col("j.valid")).alias("finalized_after_retry"))


def miss_counts(judged: DataFrame) -> DataFrame:
    """k observed misses, m invalid, n drawn, with leak types, low confidence and truncation strata."""
    c = F.col
    miss = c("valid") & c("leaked")
    return judged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("k"), F.count_if(~c("valid")).alias("m"),
        *[F.count_if(miss & (c("leak_type") == x)).alias(f"k_{x}") for x in ("verbatim", "partial", "semantic")],
        F.count_if(c("valid") & (c("confidence") == "low")).alias("n_low_confidence"),
        F.count_if(miss & (c("confidence") == "low")).alias("k_low_confidence"),
        F.count_if(c("valid") & c("truncated")).alias("n_truncated"), F.count_if(miss & c("truncated")).alias("k_truncated"),
        F.count_if(c("valid") & ~c("truncated")).alias("n_whole"), F.count_if(miss & ~c("truncated")).alias("k_whole"))


def prevalence(df: DataFrame, k, n, pool: Column | None = None, prefix: str = "") -> DataFrame:
    """Point (NULL without observations), Wilson and, with a pool, exact hypergeometric bounds."""
    lo, hi = wilson(k, n)
    out = df.withColumn(f"{prefix}point", rate(k, n, None)).withColumn(f"{prefix}lo", lo).withColumn(f"{prefix}hi", hi)
    if pool is not None:
        hlo, hhi = hypergeometric_interval(k, n, pool)
        out = out.withColumn(f"{prefix}hyper_lo", hlo).withColumn(f"{prefix}hyper_hi", hhi)
    return out


def missingness_band(df: DataFrame, pool: Column | None = None) -> DataFrame:
    """Prevalence if no invalid judgment were a miss, if all were, and among the valid ones."""
    k, m, n = F.col("k"), F.col("m"), F.col("n")
    out = prevalence(df, k, n, pool, "optimistic_")
    out = prevalence(out, k + m, n, pool, "pessimistic_")
    return prevalence(out, k, n - m, None, "complete_case_").withColumn("degenerate", m == 0).withColumn("estimable", n - m > 0)


def census_status(drawn, valid, pool) -> Column:
    return F.when(drawn < pool, "not_a_census").when(valid < pool, "incomplete_invalid").otherwise("complete")
