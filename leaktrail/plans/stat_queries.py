"""Intervals, tests, pairing, resampling, sampling and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import stats
from leaktrail.operators import judged, paired, resample, sampling
from leaktrail.plans.flow_queries import event_bucket
from leaktrail.plans.rate_queries import V, verdicts
from leaktrail.plans.registry import query, table
from leaktrail.plans.views import ARMS_SQL, OUTCOMES_SQL, WHOLE_ARMS_SQL, arms, outcomes, tool_events, whole_arms, with_sql
from leaktrail.session import staged

OUT = with_sql(OUTCOMES_SQL)
ARMS = with_sql(ARMS_SQL)
Z = repr(v.Z95)
PAIRS = with_sql(ARMS_SQL, WHOLE_ARMS_SQL).rstrip() + ", pairs AS (SELECT user_id, event_type, b.unsafe AS b, d.unsafe AS d FROM whole_arms b JOIN whole_arms d USING (user_id, event_type) WHERE b.arm = 'baseline' AND d.arm = 'defense')\n"
CELLS = "cells AS (SELECT event_type, count(*) AS n, count(*) FILTER (b = 0 AND d = 1) AS b, count(*) FILTER (b = 1 AND d = 0) AS c FROM pairs GROUP BY ALL)\n"
#: ln n! in DuckDB
LF = "lgamma(({}) + 1.0)"


def lf(x):
    return LF.format(x)


def _arms(spark, sf_dir):
    a = arms(spark, sf_dir)
    return a.filter("arm = 'baseline'"), a.filter("arm = 'defense'")


def _whole_arms(spark, sf_dir):
    a = whole_arms(spark, sf_dir)
    return a.filter("arm = 'baseline'"), a.filter("arm = 'defense'")


def _pairs(spark, sf_dir):
    """Whole arms over the registry of cells, paired; a cell that an arm lacks or has twice aborts."""
    return paired.paired_rows(*_whole_arms(spark, sf_dir), ["user_id", "event_type"], "unsafe")


def _cells(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("b = 0 AND d = 1")).alias("b"), F.count_if(F.expr("b = 1 AND d = 0")).alias("c"))


def _model_counts(spark, sf_dir):
    c = F.col("env_class") == "risky"
    return outcomes(spark, sf_dir).groupBy("mechanism").agg(
        F.count_if(c).alias("n1"), F.count_if(c & F.col("any_risk")).alias("k1"), F.count_if(~c).alias("n2"), F.count_if(~c & F.col("any_risk")).alias("k2"))


COUNTS = OUT.rstrip() + """, counts AS (SELECT mechanism, count(*) FILTER (env_class = 'risky') AS n1, count(*) FILTER (env_class = 'risky' AND any_risk) AS k1,
  count(*) FILTER (env_class <> 'risky') AS n2, count(*) FILTER (env_class <> 'risky' AND any_risk) AS k2 FROM outcomes GROUP BY ALL)\n"""


@query("wilson_intervals", "STA-1", COUNTS + f"""SELECT mechanism, CASE WHEN n1 = 0 THEN 0.0 ELSE round(greatest(0.0, (p + z2 / (2 * n1) - {Z} * sqrt(p * (1 - p) / n1 + z2 / (4.0 * n1 * n1))) / (1 + z2 / n1)), 9) END AS lo,
  CASE WHEN n1 = 0 THEN 1.0 ELSE round(least(1.0, (p + z2 / (2 * n1) + {Z} * sqrt(p * (1 - p) / n1 + z2 / (4.0 * n1 * n1))) / (1 + z2 / n1)), 9) END AS hi
FROM (SELECT *, CAST(k1 AS DOUBLE) / n1 AS p, CAST({Z} AS DOUBLE) * {Z} AS z2 FROM counts)""")
def wilson_intervals(spark, sf_dir):
    lo, hi = stats.wilson("k1", "n1")
    return _model_counts(spark, sf_dir).select("mechanism", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("bca_intervals", "STA-2, STA-6")
def bca_intervals(spark, sf_dir):
    d = outcomes(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("any_risk").alias("k"))
    return resample.bca_interval(d, "k", "n")


@query("normal_functions", "STA-6", COUNTS + """SELECT mechanism, round(CASE WHEN q < 0.5 THEN -u ELSE u END, 9) AS z FROM (
  SELECT *, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS u FROM (
    SELECT *, sqrt(-2 * ln(least(q, 1 - q))) AS t FROM (SELECT mechanism, (k1 + 1.0) / (n1 + 2.0) AS q FROM counts)))""")
def normal_functions(spark, sf_dir):
    q = (F.col("k1") + 1.0) / (F.col("n1") + 2.0)
    return _model_counts(spark, sf_dir).select("mechanism", F.round(stats.normal_quantile(q), 9).alias("z"))


@query("pairing_audit", "JON-9, SET-2", ARMS + """SELECT count(*) FILTER (nb IS NOT NULL AND nd IS NOT NULL) AS n_paired, count(*) FILTER (nd IS NULL) AS n_baseline_only,
  count(*) FILTER (nb IS NULL) AS n_defense_only, count(*) FILTER (nb > 1 OR nd > 1) AS n_duplicate FROM (
  SELECT count(*) FILTER (arm = 'baseline') AS b0, nullif(count(*) FILTER (arm = 'baseline'), 0) AS nb, nullif(count(*) FILTER (arm = 'defense'), 0) AS nd FROM arms GROUP BY user_id, event_type)""")
def pairing_audit(spark, sf_dir):
    return paired.pairing_audit(*_arms(spark, sf_dir), ["user_id", "event_type"])


@query("paired_discordance", "JON-9, STA-16, STA-17", PAIRS + """SELECT event_type, count(*) AS n_pairs, count(*) FILTER (b = 1 AND d = 1) AS both, count(*) FILTER (b = 0 AND d = 1) AS b_safe_to_unsafe,
  count(*) FILTER (b = 1 AND d = 0) AS c_unsafe_to_safe, count(*) FILTER (b = 0 AND d = 0) AS neither, CAST(sum(d - b) AS DOUBLE) / count(*) AS diff,
  CASE WHEN count(*) FILTER (b = 0 AND d = 1) > 0 THEN count(*) FILTER (b = 1 AND d = 0) / count(*) FILTER (b = 0 AND d = 1) END AS ratio_c_over_b FROM pairs GROUP BY ALL""")
def paired_discordance(spark, sf_dir):
    return paired.discordance(_pairs(spark, sf_dir), ["event_type"])


@query("pair_rates", "STA-17", PAIRS + """SELECT mechanism, n_pairs, n_tasks, baseline_unsafe, residual_unsafe, baseline_unsafe / n_pairs AS baseline_rate, residual_unsafe / n_pairs AS residual_rate FROM (
  SELECT event_type AS mechanism, count(*) AS n_pairs, count(DISTINCT user_id) AS n_tasks, CAST(sum(b) AS BIGINT) AS baseline_unsafe, CAST(sum(d) AS BIGINT) AS residual_unsafe FROM pairs GROUP BY ALL)""")
def pair_rates(spark, sf_dir):
    return paired.pair_rates(_pairs(spark, sf_dir).withColumnRenamed("event_type", "mechanism"), ["mechanism"], "user_id")


@query("risk_only_pair_rates", "STA-17", PAIRS + """, m AS (SELECT *, CASE event_type WHEN 'view' THEN 'browser_to_local' WHEN 'click' THEN 'benign_control' ELSE event_type END AS mechanism FROM pairs),
g AS (SELECT *, 'all_risk_mechanisms' AS grp FROM m WHERE mechanism <> 'benign_control' UNION ALL
      SELECT *, CASE WHEN mechanism = 'browser_to_local' THEN mechanism ELSE 'other_risk_mechanisms' END FROM m WHERE mechanism <> 'benign_control')
SELECT grp AS "group", count(*) AS n_pairs, count(DISTINCT user_id) AS n_tasks, CAST(sum(b) AS BIGINT) AS baseline_unsafe, CAST(sum(d) AS BIGINT) AS residual_unsafe, sum(b) / count(*) AS baseline_rate, sum(d) / count(*) AS residual_rate FROM g GROUP BY ALL""")
def risk_only_pair_rates(spark, sf_dir):
    mech = F.when(F.col("event_type") == "view", "browser_to_local").when(F.col("event_type") == "click", "benign_control").otherwise(F.col("event_type"))
    return paired.risk_only_rates(_pairs(spark, sf_dir).withColumn("mechanism", mech), "mechanism", "user_id")


@query("attribute_changes", "JON-13, RED-6", """WITH b AS (SELECT o_custkey, o_orderkey % 7 AS k, any_value(o_orderpriority) AS p, max(o_orderstatus) AS s FROM orders GROUP BY ALL HAVING count(*) = 1)
SELECT count(*) FILTER (x.p IS DISTINCT FROM y.p) AS priority_diff_pairs, count(*) FILTER (x.s IS DISTINCT FROM y.s) AS status_diff_pairs
FROM b x JOIN b y ON x.o_custkey = y.o_custkey AND x.k = 0 AND y.k = 1""")
def attribute_changes(spark, sf_dir):
    """Orders of the same customer in two arms (order number modulo 7): how often do attributes differ?

    Its SQL reads two of seven order classes; ``attribute_changes_all`` compares every order.
    """
    b = (table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 7).alias("k"))
         .agg(F.max("o_orderpriority").alias("p"), F.max("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("n")).filter("n = 1"))
    x = b.filter("k = 0").select("o_custkey", F.col("p").alias("priority_b"), F.col("s").alias("status_b"))
    y = b.filter("k = 1").select("o_custkey", F.col("p").alias("priority_d"), F.col("s").alias("status_d"))
    return paired.attribute_changes(x.join(y, "o_custkey"), ["priority", "status"])


@query("attribute_changes_all", "JON-13, RED-6", """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS f, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 = 0 ORDER BY o_orderkey) AS position FROM orders),
j AS (SELECT x.o_orderkey AS xk, y.o_orderkey AS yk, x.o_orderpriority AS xp, y.o_orderpriority AS yp, x.o_orderstatus AS xs, y.o_orderstatus AS ys
  FROM (SELECT * FROM o WHERE f) x FULL JOIN (SELECT * FROM o WHERE NOT f) y ON x.o_custkey = y.o_custkey AND x.position = y.position)
SELECT count(*) FILTER (xk IS NOT NULL AND yk IS NOT NULL) AS n_pairs, count(*) FILTER (yk IS NULL) AS n_baseline_only, count(*) FILTER (xk IS NULL) AS n_defense_only,
  count(*) FILTER (xk IS NOT NULL AND yk IS NOT NULL AND xp IS DISTINCT FROM yp) AS priority_diff_pairs, count(*) FILTER (xk IS NOT NULL AND yk IS NOT NULL AND xs IS DISTINCT FROM ys) AS status_diff_pairs FROM j""")
def attribute_changes_all(spark, sf_dir):
    """Every order: arms by parity of the order number, a customer's n-th orders of both arms compared, orders without a partner counted."""
    j = paired.paired_by_position(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey") % 2 == 0, "o_orderkey", event_bucket("o_orderkey"),
                                  {"priority": "o_orderpriority", "status": "o_orderstatus"})
    match = F.col("side") == "paired"
    return j.agg(F.count_if(match).alias("n_pairs"), *[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("baseline_only", "defense_only")],
                 *[F.count_if(match & ~F.col(f"{n}_b").eqNullSafe(F.col(f"{n}_d"))).alias(f"{n}_diff_pairs") for n in ("priority", "status")])


@query("registry_pairs", "JON-10", """WITH cells AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS n1, count(*) FILTER (o_orderkey % 2 = 1) AS n2,
  max(CAST(o_totalprice > 150000 AS INT)) FILTER (o_orderkey % 2 = 0) AS b, max(CAST(o_totalprice > 150000 AS INT)) FILTER (o_orderkey % 2 = 1) AS d FROM orders GROUP BY ALL HAVING n1 = 1 AND n2 = 1)
SELECT o_custkey, b, d FROM cells""")
def registry_pairs(spark, sf_dir):
    """Registry: customers with exactly one order per arm; both arms must cover it.

    Its SQL takes the registry from the orders themselves; ``registry_coverage`` takes it from the customers.
    """
    orders = table(spark, sf_dir, "orders").withColumn("arm", F.when(F.col("o_orderkey") % 2 == 0, "first").otherwise("second"))
    registry = (orders.groupBy("o_custkey").agg(F.count_if(F.expr("arm = 'first'")).alias("n1"), F.count_if(F.expr("arm = 'second'")).alias("n2"))
                .filter("n1 = 1 AND n2 = 1"))
    return paired.registry_pairs(orders, registry, "o_custkey", "arm", "first", "second", F.col("o_totalprice") > 150000)


@query("registry_coverage", "JON-10", """WITH cells AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS n1, count(*) FILTER (o_orderkey % 2 = 1) AS n2,
  max(CAST(o_totalprice > 150000 AS INT)) FILTER (o_orderkey % 2 = 0) AS b, max(CAST(o_totalprice > 150000 AS INT)) FILTER (o_orderkey % 2 = 1) AS d FROM orders GROUP BY ALL),
g AS (SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, b, d, CASE WHEN c_custkey IS NULL THEN 'unregistered' WHEN coalesce(n1 + n2, 0) = 0 THEN 'missing'
  WHEN n1 = 0 THEN 'second_only' WHEN n2 = 0 THEN 'first_only' WHEN n1 > 1 OR n2 > 1 THEN 'ambiguous' ELSE 'covered' END AS status FROM customer FULL JOIN cells ON c_custkey = o_custkey)
SELECT custkey, n1, n2, status, CASE WHEN status = 'covered' THEN b END AS b, CASE WHEN status = 'covered' THEN d END AS d FROM g""")
def registry_coverage(spark, sf_dir):
    """Registry: the customer table; covered pairs and violations (an arm missing, several orders in one, not registered) as rows."""
    orders = table(spark, sf_dir, "orders").withColumn("arm", F.when(F.col("o_orderkey") % 2 == 0, "first").otherwise("second")).withColumnRenamed("o_custkey", "custkey")
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return paired.registry_coverage(orders, registry, "custkey", "arm", "first", "second", F.col("o_totalprice") > 150000)


@query("rater_join", "JON-11, STA-14", """WITH r AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b FROM labels)
SELECT tt, ta, tb, ff, (ff + tt) AS agree, round(((tt + ff) / n - pe) / (1 - pe), 9) AS kappa FROM (
  SELECT *, ((tt + ta) / n) * ((tt + tb) / n) + (1 - (tt + ta) / n) * (1 - (tt + tb) / n) AS pe FROM (
    SELECT count(*) AS n, count(*) FILTER (a AND b) AS tt, count(*) FILTER (a AND NOT b) AS ta, count(*) FILTER (NOT a AND b) AS tb, count(*) FILTER (NOT a AND NOT b) AS ff FROM r))""")
def rater_join(spark, sf_dir):
    from leaktrail.operators.agreement import confusion

    lab = table(spark, sf_dir, "labels")
    a = lab.select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("label"))
    b = lab.select(F.col("doc_id").alias("task_id"), (F.col("toxic") == 0).alias("label"))
    t = confusion(a, b)
    return t.select("tt", "ta", "tb", "ff", (F.col("tt") + F.col("ff")).alias("agree"),
                    F.round(stats.kappa("tt", "ta", "tb", "ff"), 9).alias("kappa"))


@query("kappa_interval", "STA-15")
def kappa_interval(spark, sf_dir):
    from leaktrail.operators.agreement import confusion

    lab = table(spark, sf_dir, "labels")
    t = confusion(lab.select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("label")),
                  lab.select(F.col("doc_id").alias("task_id"), (F.col("toxic") == 0).alias("label")))
    return resample.kappa_interval(t, "tt", "ta", "tb", "ff")


@query("design_gaps", "JON-14", """SELECT m.user_model AS model, x.mechanism FROM (SELECT DISTINCT 'model_' || (user_id % 5) AS user_model FROM events) m CROSS JOIN (VALUES """ +
       ", ".join(f"('{m}')" for m in v.RISK_MECHANISMS) + """) x(mechanism) WHERE (m.user_model, x.mechanism) NOT IN (""" + V.replace("WITH ", "WITH ", 1) +
       "SELECT model, mechanism FROM verdicts WHERE any_risk)")
def design_gaps(spark, sf_dir):
    d = verdicts(spark, sf_dir)
    return sampling.empty_cells(d.filter("any_risk"), d, "model", "mechanism")


@query("wald_intervals", "STA-8", PAIRS.rstrip() + ", " + CELLS + f"""SELECT event_type, round((b - c) / n - {Z} * se, 9) AS lo, round((b - c) / n + {Z} * se, 9) AS hi
FROM (SELECT *, sqrt(greatest(0.0, (b + c - CAST(b - c AS DOUBLE) * (b - c) / n) / (CAST(n AS DOUBLE) * n))) AS se FROM cells)""")
def wald_intervals(spark, sf_dir):
    lo, hi = stats.wald_paired("n", "b", "c")
    return _cells(spark, sf_dir).select("event_type", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("tango_intervals", "STA-7")
def tango_intervals(spark, sf_dir):
    lo, hi = stats.tango("n", "b", "c")
    return _cells(spark, sf_dir).select("event_type", "n", "b", "c", lo.alias("lo"), hi.alias("hi"))


@query("mcnemar_exact", "STA-9", PAIRS.rstrip() + ", " + CELLS + f"""SELECT event_type, round(least(1.0, 2 * tail), 7) AS p FROM (
  SELECT event_type, (SELECT sum(exp({lf('b + c')} - {lf('i')} - {lf('b + c - i')} - (b + c) * ln(2.0))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS i)) AS tail FROM cells)""")
def mcnemar_exact(spark, sf_dir):
    return _cells(spark, sf_dir).select("event_type", F.round(stats.mcnemar_exact("b", "c"), 7).alias("p"))


def _hyp(x, row, col, n):
    def ch(a, b):
        return f"({lf(a)} - {lf(b)} - {lf(f'({a}) - ({b})')})"
    return f"({ch(col, x)} + {ch(f'({n}) - ({col})', f'({row}) - ({x})')} - {ch(n, row)})"


_ROW, _COL, _N = "n1", "k1 + k2", "n1 + n2"


@query("fisher_exact", "STA-10", COUNTS + f"""SELECT mechanism, round(least(1.0, p), 7) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (
  SELECT mechanism, (SELECT sum(CASE WHEN {_hyp('x', _ROW, _COL, _N)} <= {_hyp('k1', _ROW, _COL, _N)} + 1e-7 THEN exp({_hyp('x', _ROW, _COL, _N)}) ELSE 0 END)
    FROM (SELECT unnest(range(greatest(0, n1 + k1 + k2 - n1 - n2), least(n1, k1 + k2) + 1)) AS x)) AS p FROM counts)""")
def fisher_exact(spark, sf_dir):
    c = _model_counts(spark, sf_dir)
    p = stats.fisher_exact("k1", F.col("n1") - F.col("k1"), "k2", F.col("n2") - F.col("k2"))
    c = c.withColumn("p0", p)
    return c.select("mechanism", F.round("p0", 7).alias("p"), stats.stars("p0").alias("stars"))


@query("permutation_test", "STA-5", COUNTS + f"""SELECT mechanism, round(least(1.0, p), 7) AS p FROM (
  SELECT mechanism, (SELECT sum(CASE WHEN abs(x / n1 - (k1 + k2 - x) / n2) >= abs(k1 / n1 - k2 / n2) - 1e-12 THEN exp({_hyp('x', _ROW, _COL, _N)}) ELSE 0 END)
    FROM (SELECT unnest(range(greatest(0, n1 + k1 + k2 - n1 - n2), least(n1, k1 + k2) + 1)) AS x)) AS p FROM counts)""")
def permutation_test(spark, sf_dir):
    return _model_counts(spark, sf_dir).select("mechanism", F.round(stats.permutation_p("k1", "n1", "k2", "n2"), 7).alias("p"))


_T = "SELECT unnest(range(0, pool + 1)) AS kk"


def _tail(cmp):
    lo, hi = "greatest(0, n + kk - pool)", "least(n, kk)"
    return f"(SELECT coalesce(sum(exp({_hyp('x', 'n', 'kk', 'pool')})), 0) FROM (SELECT unnest(range({lo}, {hi} + 1)) AS x) WHERE x {cmp} k)"


@query("finite_population_interval", "STA-11, STA-12", OUT + f""", base AS (SELECT mechanism, count(*) AS pool, count(*) FILTER (doc_id % 3 = 0) AS n, count(*) FILTER (doc_id % 3 = 0 AND any_risk) AS k FROM outcomes GROUP BY ALL),
grid AS (SELECT b.*, kk FROM base b, LATERAL ({_T}))
SELECT mechanism, min(kk) FILTER (up > 0.025) / any_value(pool) AS hyper_lo, max(kk) FILTER (down > 0.025) / any_value(pool) AS hyper_hi, CASE WHEN any_value(n) > 0 THEN any_value(k) / any_value(n) END AS point
FROM (SELECT *, {_tail('>=')} AS up, {_tail('<=')} AS down FROM grid) GROUP BY mechanism""")
def finite_population_interval(spark, sf_dir):
    drawn = F.col("doc_id") % 3 == 0
    d = outcomes(spark, sf_dir).groupBy("mechanism").agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(drawn).alias("n"), F.count_if(drawn & F.col("any_risk")).alias("k"))
    return judged.prevalence(d, F.col("k"), F.col("n"), F.col("pool")).select("mechanism", "hyper_lo", "hyper_hi", "point")


@query("missingness_band", "STA-12, STA-13, JDG-3", OUT + """, j AS (SELECT *, doc_id % 10 <> 3 AS valid, any_risk AS leaked, n_chars > 3000 AS truncated FROM outcomes)
SELECT n, k, m, k / n AS optimistic_point, (k + m) / n AS pessimistic_point, k / (n - m) AS complete_case_point, n_truncated, k_truncated, n_whole, k_whole, 'incomplete_invalid' AS status FROM (
  SELECT count(*) AS n, count(*) FILTER (valid AND leaked) AS k, count(*) FILTER (NOT valid) AS m, count(*) FILTER (valid AND truncated) AS n_truncated, count(*) FILTER (valid AND leaked AND truncated) AS k_truncated,
    count(*) FILTER (valid AND NOT truncated) AS n_whole, count(*) FILTER (valid AND leaked AND NOT truncated) AS k_whole FROM j)""")
def missingness_band(spark, sf_dir):
    j = outcomes(spark, sf_dir).select((F.col("doc_id") % 10 != 3).alias("valid"), F.col("any_risk").alias("leaked"), (F.col("n_chars") > 3000).alias("truncated"),
                                       F.lit("semantic").alias("leak_type"), F.lit("high").alias("confidence"))
    band = judged.missingness_band(judged.miss_counts(j), F.col("n"))
    status = judged.census_status(F.col("n"), F.col("n") - F.col("m"), F.col("n"))
    return band.select("n", "k", "m", "optimistic_point", "pessimistic_point", "complete_case_point", "n_truncated", "k_truncated", "n_whole", "k_whole", status.alias("status"))


@query("merged_judgments", "JDG-2", """WITH a AS (SELECT conv_id AS sample_key, turn + 1 AS attempt, length(text) % 3 = 0 AS valid, length(text) % 2 = 0 AS leaked, length(text) AS total_tokens FROM conversations),
best AS (SELECT sample_key, arg_min((leaked, valid), (NOT valid, CASE WHEN valid THEN attempt ELSE -attempt END)) AS j, count(*) AS judge_attempts, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM a GROUP BY ALL)
SELECT sample_key, j[1] AS leaked, j[2] AS valid, judge_attempts, total_tokens, judge_attempts > 1 AND j[2] AS finalized_after_retry FROM best""")
def merged_judgments(spark, sf_dir):
    n = F.length("text")
    a = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("sample_key"), (F.col("turn") + 1).alias("attempt"), (n % 3 == 0).alias("valid"), (n % 2 == 0).alias("leaked"),
        F.lit("high").alias("confidence"), F.lit("none").alias("leak_type"), F.lit(False).alias("truncated"), n.alias("total_tokens"))
    return judged.merge_attempts(a).select("sample_key", "leaked", "valid", "judge_attempts", "total_tokens", "finalized_after_retry")


@query("difference_interval", "STA-4, STA-20")
def difference_interval(spark, sf_dir):
    b, d = _arms(spark, sf_dir)
    both = arms(spark, sf_dir).groupBy("event_type").agg(
        F.count_if(F.expr("arm = 'defense'")).alias("nd"), F.count_if(F.expr("arm = 'defense' AND useful = 1")).alias("kd"),
        F.count_if(F.expr("arm = 'baseline'")).alias("nb"), F.count_if(F.expr("arm = 'baseline' AND useful = 1")).alias("kb"))
    return resample.difference_interval(both, "kd", "nd", "kb", "nb")


REPS = v.RESAMPLES
_CLUSTER_SQL = f"""clusters AS (SELECT user_id, sum(d - b) AS total, count(*) AS cnt, sha256(user_id || '') AS h FROM pairs GROUP BY user_id),
ids AS (SELECT *, row_number() OVER (ORDER BY h, user_id) - 1 AS id, count(*) OVER () AS n FROM clusters),
draws AS (SELECT r.rep, ('0x' || substr(sha256('42:' || r.rep || ':' || (i.id // 8)), CAST(1 + 8 * (i.id % 8) AS BIGINT), 8))::BIGINT % i.n AS pick FROM ids i, (SELECT unnest(range(0, {REPS})) AS rep) r),
reps AS (SELECT rep, CAST(sum(total) AS DOUBLE) / sum(cnt) AS stat FROM draws JOIN ids ON pick = id GROUP BY rep)"""


@query("cluster_bootstrap", "STA-3", PAIRS.rstrip() + ", " + _CLUSTER_SQL + " SELECT round(quantile_cont(stat, 0.025), 4) AS lo, round(quantile_cont(stat, 0.975), 4) AS hi FROM reps")
def cluster_bootstrap(spark, sf_dir):
    return paired.task_difference_interval(_pairs(spark, sf_dir), "user_id", resamples=REPS)


@query("eligible_pool", "SMP-1", V + "SELECT trace_id, mechanism <> 'benign_control' AS in_pool FROM verdicts WHERE env_class = 'risky' AND NOT any_risk AND sensitive_data_read")
def eligible_pool(spark, sf_dir):
    return sampling.eligible(verdicts(spark, sf_dir)).select("trace_id", "in_pool")


@query("simple_sample", "SMP-2", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY sha256('{v.SAMPLE_SEED}:' || event_id), event_id) AS rn FROM events) WHERE rn <= 150")
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(table(spark, sf_dir, "events").select("event_id"), "event_id", 150)


@query("proportional_allocation", "SMP-3, WIN-11")
def proportional_allocation(spark, sf_dir):
    cells = outcomes(spark, sf_dir).groupBy(F.concat_ws("::", "model", "mechanism").alias("cell")).agg(F.count(F.lit(1)).alias("pool"))
    return sampling.allocate(cells, 150)


_ALLOC_SQL = """cells AS (SELECT event_type AS cell, count(*) AS pool FROM events GROUP BY ALL),
a AS (SELECT *, 400 * pool // sum(pool) OVER () AS fl, 400 * pool % sum(pool) OVER () AS rem FROM cells),
quota AS (SELECT cell, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, cell) <= 400 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS drawn FROM a)"""


@query("stratified_sample", "SMP-3, SMP-4", f"""WITH {_ALLOC_SQL} SELECT event_id, cell FROM (SELECT event_id, event_type AS cell, row_number() OVER (PARTITION BY event_type ORDER BY sha256('{v.SAMPLE_SEED}:' || event_type || ':' || event_id), event_id) AS rn FROM events) JOIN quota USING (cell) WHERE rn <= drawn""")
def stratified_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_sample(e, F.col("event_type"), "event_id", 400).select("event_id", "cell")


@query("sample_coverage", "SMP-5", f"""SELECT event_type, count(*) AS pool, count(*) FILTER (rn <= 150) AS drawn, count(*) FILTER (rn <= 150) = 0 AS uncovered FROM (
  SELECT event_type, row_number() OVER (ORDER BY sha256('{v.SAMPLE_SEED}:' || event_id), event_id) AS rn FROM events) GROUP BY ALL""")
def sample_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.coverage(e, sampling.simple_sample(e, "event_id", 150), ["event_type"])


@query("grouped_split", "SMP-6", """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY substr(sha256('0:' || user_id), 1, 8), user_id) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
s AS (SELECT user_id, CASE WHEN rk < greatest(1, round_even(n * 0.15, 0)) THEN 'calibration' WHEN rk < greatest(1, round_even(n * 0.15, 0)) + greatest(1, round_even(n * 0.35, 0)) THEN 'validation' ELSE 'test' END AS split FROM g)
SELECT split, count(DISTINCT user_id) AS n_groups, count(*) AS n FROM events JOIN s USING (user_id) GROUP BY ALL""")
def grouped_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.grouped_split(e, "user_id").groupBy("split").agg(F.count_distinct("user_id").alias("n_groups"), F.count(F.lit(1)).alias("n"))


@query("live_guard_report", "STA-20")
def live_guard_report(spark, sf_dir):
    """Safety, utility and diagnostics of the two whole arms, stacked as (section, name, value).

    A cell is blocked if the guard blocked one of its calls, and has a residual if a blocked call still carries the core.
    """
    keys, c = ["user_id", "event_type"], F.col
    half = F.when(c("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp"), "baseline").otherwise("defense")
    kinds = table(spark, sf_dir, "events").select(c("event_id").alias("idx"), "event_type")
    guarded = tool_events(spark, sf_dir).join(kinds, "idx").groupBy(*keys, half.alias("arm")).agg(
        F.max(c("taint_blocked").cast("int")).alias("blocked"),
        F.max((c("taint_blocked") & F.contains("sanitized_args", c("secret_core"))).cast("int")).alias("residual"))
    whole = whole_arms(spark, sf_dir).join(guarded, [*keys, "arm"], "left").fillna(0, ["blocked", "residual"]).withColumn("mechanism", c("event_type"))
    whole = staged(whole, "whole-arms")
    b, d = whole.filter("arm = 'baseline'"), whole.filter("arm = 'defense'")
    parts = paired.live_guard_report(b, d, keys, "user_id", "mechanism", resamples=REPS)
    out = None
    for name, frame in parts.items():
        key = [c for c in ("mechanism", "group") if c in frame.columns]
        nums = [c for c in frame.columns if c not in key]
        long = frame.select(*(F.col(k) for k in key), *[F.col(c).cast("double").alias(c) for c in nums]).unpivot(key, nums, "name", "value")
        long = long.select(F.lit(name).alias("section"), (F.col(key[0]) if key else F.lit("all")).alias("group"), "name", "value")
        out = long if out is None else out.unionByName(long)
    return out


@query("provenance", "RED-6, PRJ-30", """SELECT *, CAST(baseline_first AS DATE) = CAST(baseline_last AS DATE) AND CAST(baseline_last AS DATE) = CAST(defense_first AS DATE) AND CAST(defense_first AS DATE) = CAST(defense_last AS DATE) AS same_day,
  baseline_last <= defense_first AS baseline_before_defense FROM (SELECT count(*) FILTER (b) AS n_baseline, count(*) FILTER (NOT b) AS n_defense, min(ts) FILTER (b) AS baseline_first, max(ts) FILTER (b) AS baseline_last, min(ts) FILTER (NOT b) AS defense_first, max(ts) FILTER (NOT b) AS defense_last,
  count(DISTINCT event_type) = 1 AS same_event_type FROM (SELECT *, ts < TIMESTAMP '2024-01-16 00:00:00' AS b FROM events))""")
def provenance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    return paired.provenance(e.filter(cut), e.filter(~cut), ["event_type"], "ts")
