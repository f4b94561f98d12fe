"""Operators against brute force on small fixtures, including the forms used for hot keys and many buckets."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import stats
from leaktrail.operators import agreement, features, grouped, judged, paired, quality, rates, redaction, regress, resample, sampling


#: both true, only first, only second, both false
KAPPA_CELLS = (13, 8, 1, 125)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([None, 1, 2, 3, 5]), rng.random() < 0.6, rng.choice("ab")) for i, k in enumerate(rng.choices("xyz", [5, 2, 1], k=400))]
    return data, spark.createDataFrame(data, "k string, i bigint, x int, on boolean, g string")


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_running(spark, series, width):
    data, df = series
    bucket = F.floor(F.col("i") / width)
    got = grouped.running(df, ["k"], "i", bucket, {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "last": ("last", F.col("x"))},
                          runs={"plain": (F.col("on"), None, None, None), "by_group": (F.col("on"), "g", None, None)})
    got = {r.i: r for r in got.collect()}
    before = {r.i: r.before for r in grouped.previous(df, ["k"], "i", bucket, {"before": "g"}).collect()}
    state = {}
    for k, i, x, on, g in data:
        s = state.setdefault(k, dict(xs=[], plain=0, grp=0, g=None))
        assert before[i] == s["g"]
        s["xs"] += [x] if x is not None else []
        s["plain"] = s["plain"] + 1 if on else 0
        s["grp"] = 0 if not on else (s["grp"] + 1 if s["g"] in (g, None) else 1)
        s["g"] = g
        r = got[i]
        assert (r.s, r.lo, r.hi, r.last) == (sum(s["xs"]), min(s["xs"], default=None), max(s["xs"], default=None), s["xs"][-1] if s["xs"] else None)
        assert (r.plain, r.by_group) == (s["plain"], s["grp"])


@pytest.mark.parametrize("hot", [0, 20, 10**9])
def test_attach_facts(spark, series, hot):
    _, df = series
    facts = df.groupBy("k").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n"))
    got = grouped.attach_facts(df, facts, ["k"], F.col("i"), "n", hot_rows=hot, salts=8)
    assert rows(got.select("i", "t"), "i") == rows(df.join(facts, "k").select("i", "t"), "i")


def test_ordered_ids_and_first_wins(spark, series):
    data, df = series
    h = df.withColumn("h", F.sha2(F.col("i").cast("string"), 256))
    ids = grouped.ordered_ids(h, ["h"], F.substring("h", 1, 2))
    assert [r[0] for r in ids.orderBy("h").select("id").collect()] == list(range(len(data)))
    firsts = {k: i for k, i, *_ in reversed(data)}
    lasts = {k: i for k, i, *_ in data}
    assert dict(rows(grouped.first_wins(df, ["k"], ["i"]).select("k", "i"))) == firsts
    assert dict(rows(grouped.first_wins(df, ["k"], ["i"], last=True).select("k", "i"))) == lasts


def test_digest(spark):
    def digest(data):
        return quality.table_digest(spark.createDataFrame(data, "a string"), F.col("a")).first().digest

    base = [("x",), ("y",), ("y",)]
    assert digest(base) == digest([("y",), ("x",), ("y",)])
    assert len({digest(base), digest([("x",), ("x",), ("y",)]), digest([("x",), ("y",)]), digest([("x",), ("y",), ("z",)])}) == 4


def allocation(pool, size):
    """Textbook largest remainder with saturation, on exact fractions."""
    from fractions import Fraction

    total, fixed = sum(pool.values()), {}
    want = min(size, total)
    while True:
        active = {c: n for c, n in pool.items() if c not in fixed}
        left = want - sum(fixed.values())
        if not active:
            return fixed
        ideal = {c: Fraction(left * n, sum(active.values())) for c, n in active.items()}
        draw = {c: math.floor(x) for c, x in ideal.items()}
        for c in sorted(active, key=lambda c: (-(ideal[c] - draw[c]), c))[:left - sum(draw.values())]:
            draw[c] += 1
        full = {c for c in active if draw[c] >= active[c]}
        if not full:
            return {**fixed, **draw}
        fixed.update({c: active[c] for c in full})


@pytest.mark.parametrize("pool,size", [({"a": 1, "b": 1, "c": 100}, 10), ({"a": 1, "b": 2, "c": 3}, 5), ({"a": 5, "b": 5}, 50), ({"a": 700, "b": 31, "c": 7, "d": 1}, 150), ({"a": 3, "b": 3, "c": 3}, 1)])
def test_allocation(spark, pool, size):
    got = {r.cell: r.drawn for r in sampling.allocate(spark.createDataFrame(list(pool.items()), "cell string, pool bigint"), size).collect()}
    assert got == allocation(pool, size) and sum(got.values()) == min(size, sum(pool.values()))


def test_samples(spark):
    pool = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") < 900, "big").otherwise("small").alias("c"))
    s = sampling.simple_sample(pool, "i", 100)
    assert s.count() == 100 and rows(s) == rows(sampling.simple_sample(pool.repartition(7), "i", 100))
    assert sampling.simple_sample(pool, "i", 5000).count() == 1000
    strat = sampling.stratified_sample(pool, F.col("c"), "i", 50)
    assert dict(rows(strat.groupBy("cell").count())) == {"big": 45, "small": 5}
    split = sampling.grouped_split(pool.withColumn("g", F.col("i") % 20), "g")
    assert dict(rows(split.select("g", "split").distinct().groupBy("split").count())) == {"calibration": 3, "validation": 7, "test": 10}


def arm(spark, data):
    return spark.createDataFrame([("m", *r) for r in data], "model string, task string, env string, unsafe int")


def test_pairing(spark):
    base = arm(spark, [("t1", "v1", 1), ("t1", "v2", 1), ("t2", "v1", 1), ("t2", "v2", 0)])
    safe = arm(spark, [("t1", "v1", 0), ("t1", "v2", 0), ("t2", "v1", 0), ("t2", "v2", 0)])
    keys = ["task", "env"]
    pairs = paired.paired_rows(base, safe, keys, "unsafe", model="model")
    d = paired.discordance(pairs).first()
    assert (d.n_pairs, d.diff, d.b_safe_to_unsafe, d.c_unsafe_to_safe, d.ratio_c_over_b) == (4, -0.75, 0, 3, None)
    for bad in (safe.filter("env = 'v1'"), safe.unionByName(safe.limit(1)), safe.withColumn("model", F.lit("other"))):
        with pytest.raises(paired.PairingError):
            paired.paired_rows(base, bad, keys, "unsafe", model="model")


def test_whole_arms_pair_and_a_missing_cell_aborts(spark):
    from leaktrail.plans.stat_queries import _whole_arms
    from leaktrail.plans.views import arms

    b, d = _whole_arms(spark, "/root/testdata/sf0.001")
    keys = ["user_id", "event_type"]
    cells = arms(spark, "/root/testdata/sf0.001").select(*keys).distinct().count()
    assert paired.paired_rows(b, d, keys, "unsafe").count() == b.count() == cells
    first = d.orderBy(*keys).limit(1)
    with pytest.raises(paired.PairingError, match="incomplete"):
        paired.paired_rows(b, d.join(first, keys, "left_anti"), keys, "unsafe")


def test_attribute_changes_read_every_order(spark, tmp_path):
    """Orders of all seven classes, several per customer and arm; the one without a partner is counted."""
    from leaktrail.plans.stat_queries import attribute_changes_all

    data = [(2, 1, "a", "F"), (4, 1, "b", "F"), (6, 1, "a", "O"), (3, 1, "a", "O"), (5, 1, "c", "F"), (9, 2, "a", "F")]
    spark.createDataFrame(data, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = attribute_changes_all(spark, str(tmp_path)).first().asDict()
    assert got == {"n_pairs": 2, "n_baseline_only": 1, "n_defense_only": 1, "priority_diff_pairs": 1, "status_diff_pairs": 1}


def test_registry_coverage_reports_every_customer(spark, tmp_path):
    """The registry is the customer table: customers who do not fit come back as violations."""
    from leaktrail.plans.stat_queries import registry_coverage

    spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    data = [(0, 1, 2e5), (1, 1, 1.0), (2, 2, 2e5), (3, 3, 2e5), (4, 4, 1.0), (6, 4, 1.0), (5, 4, 1.0), (8, 9, 1.0)]
    spark.createDataFrame(data, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry_coverage(spark, str(tmp_path)).select("custkey", "status", "b", "d")
    assert rows(got, "custkey") == [(1, "covered", 1, 0), (2, "first_only", None, None), (3, "second_only", None, None),
                                    (4, "ambiguous", None, None), (5, "missing", None, None), (9, "unregistered", None, None)]


def test_registry_pairs(spark):
    t = spark.createDataFrame([("a", "r", 1), ("a", "h", 0), ("b", "r", 1), ("b", "h", 1)], "task string, env string, u int")
    reg = spark.createDataFrame([("a",), ("b",)], "task string")
    assert rows(paired.registry_pairs(t, reg, "task", "env", "r", "h", F.col("u") == 1)) == [("a", 1, 0), ("b", 1, 1)]
    with pytest.raises(paired.PairingError):  # a hole in both arms
        paired.registry_pairs(t, reg.unionByName(spark.createDataFrame([("c",)], "task string")), "task", "env", "r", "h", F.col("u") == 1)


def test_bca_matches_known_values(spark):
    df = spark.createDataFrame([(387, 88), (0, 0), (1, 1), (10, 0), (10, 10)], "n bigint, k bigint")
    got = [(r.ci_lo, r.ci_hi) for r in resample.bca_interval(df, "k", "n").collect()]
    assert got[0] == pytest.approx((0.186, 0.2687), abs=0.003)
    assert got[1:] == [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (1.0, 1.0)]


def test_cluster_interval_is_wider_than_flat(spark):
    clusters = spark.createDataFrame([(f"t{i}", 3 if i < 3 else 0, 3) for i in range(6)], "t string, s bigint, n bigint")
    flat = spark.createDataFrame([(f"t{i}", 1 if i < 9 else 0, 1) for i in range(18)], "t string, s bigint, n bigint")
    c = resample.cluster_interval(clusters, "t", "s", "n", 2000).first()
    f = resample.cluster_interval(flat, "t", "s", "n", 2000).first()
    assert c.hi - c.lo > f.hi - f.lo
    assert tuple(c) == tuple(resample.cluster_interval(clusters.repartition(5), "t", "s", "n", 2000).first())
    assert tuple(resample.cluster_interval(clusters.limit(0), "t", "s", "n", 10).first()) == (0.0, 0.0)


def test_difference_interval(spark):
    df = spark.createDataFrame([(300, 387, 310, 387), (0, 0, 1, 2)], "ka bigint, na bigint, kb bigint, nb bigint")
    a, b = resample.difference_interval(df, "ka", "na", "kb", "nb").collect()
    p, q = 300 / 387, 310 / 387
    half = 1.96 * math.sqrt(p * (1 - p) / 387 + q * (1 - q) / 387)
    assert (a.diff_lo, a.diff_hi) == pytest.approx((p - q - half, p - q + half), abs=0.006)
    assert a.noninferior is False and (b.diff, b.diff_lo, b.diff_hi) == (0.0, 0.0, 0.0)


def test_kappa_golden(spark):
    """Published audit: 147 items, 138 agreements, kappa 0.7097 with interval 0.5039 to 0.8672."""
    t = spark.createDataFrame([KAPPA_CELLS], "tt bigint, ta bigint, tb bigint, ff bigint").withColumn("kappa", stats.kappa("tt", "ta", "tb", "ff"))
    r = resample.kappa_interval(t, "tt", "ta", "tb", "ff").first()
    assert sum(KAPPA_CELLS) == 147 and KAPPA_CELLS[0] + KAPPA_CELLS[3] == 138 and round(r.kappa, 4) == 0.7097
    assert (r.kappa_lo, r.kappa_hi) == pytest.approx((0.5039, 0.8672), abs=0.02)


def test_raters_must_cover_the_same_items(spark):
    a = spark.createDataFrame([("x", True), ("y", False)], "task_id string, label boolean")
    assert tuple(agreement.confusion(a, a).first()) == (1, 0, 0, 1)
    with pytest.raises(ValueError):
        agreement.confusion(a, a.limit(1))


def test_missingness(spark):
    df = spark.createDataFrame([(150, 3, 5)], "n bigint, k bigint, m bigint")
    r = judged.missingness_band(df, F.lit(698)).first()
    assert (r.optimistic_point, r.pessimistic_point, r.complete_case_point) == (3 / 150, 8 / 150, 3 / 145)
    none = judged.missingness_band(spark.createDataFrame([(5, 0, 5)], "n bigint, k bigint, m bigint")).first()
    assert none.complete_case_point is None and none.estimable is False and none.optimistic_hi < 1


def test_judgments(spark):
    good = json.dumps({"leaked": True, "confidence": "high", "leak_type": "partial", "evidence": "e"})
    raw = ["ok " + good, "nothing", '{"leaked": "false", "confidence": "high", "leak_type": "none"}', '{"leaked": true, "confidence": "sure", "leak_type": "none"}', "{broken}"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").select("i", judged.parse_judgment("x").alias("j")).orderBy("i").collect()
    assert [(r.j.valid, r.j.leaked) for r in got] == [(True, True)] + [(False, False)] * 4
    attempts = spark.createDataFrame([("a", 1, False, False), ("a", 2, True, True), ("a", 3, True, False), ("b", 1, False, False), ("b", 2, False, False)],
                                     "sample_key string, attempt int, valid boolean, leaked boolean")
    full = attempts.withColumns({"confidence": F.lit("low"), "leak_type": F.lit("none"), "truncated": F.lit(False)})
    assert rows(judged.merge_attempts(full).select("sample_key", "valid", "leaked", "judge_attempts", "finalized_after_retry")) == [("a", True, True, 3, True), ("b", False, False, 2, False)]
    assert spark.range(1).select(*[judged.census_status(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in ((5, 5, 9), (9, 8, 9), (9, 9, 9))]).first()[0:3] == ("not_a_census", "incomplete_invalid", "complete")


DIRTY = "/Users/bob/x C:\\\\Users\\\\Administrator\\\\y USERNAME=Administrator Administrator 197121 Uid: (197108/Administrator) COMPUTERNAME=DESK-1 System Administrators \"judge_api_base\": \"https://h/v1\" A_BASE_URL=https://q/z"


def test_redaction(spark):
    df = spark.createDataFrame([(DIRTY,), ("clean text, System Administrators",)], "x string")
    once = redaction.apply_rules("x")
    got = [r for r in df.select(once.alias("a"), redaction.apply_rules(once).alias("b"), redaction.residues(once).alias("r")).collect()]
    assert all(r.a == r.b and r.r == [] for r in got) and "System Administrators" in got[0].a and got[1].a == "clean text, System Administrators"
    host = redaction.apply_rules("x", redaction.host_rules("q.example"))
    assert spark.createDataFrame([('"base_url": "https://q.example/v1" https://q.example/x q.example qxexample',)], "x string").select(host).first()[0] == \
        '"base_url": "<internal-gateway>" <internal-gateway> internal-gateway qxexample'
    assert redaction.host_rules(" ") == []
    named = redaction.variable_rules(["MY_BASE_URL"], ["INIT_CWD"]) + redaction.folder_rules({"ToolFiles": "tools", "ToolFilesNew": "tools-new"})
    assert spark.createDataFrame([("MY_BASE_URL=https://a/b NOT_MY_BASE_URL=https://c X_BASE_URL=https://d INIT_CWD=/w/x ToolFilesNew/ToolFiles",)], "x string").select(
        redaction.apply_rules("x", named)).first()[0] == "MY_BASE_URL=<internal-gateway> NOT_MY_BASE_URL=https://c X_BASE_URL=https://d INIT_CWD=<HOME> tools-new/tools"
    project = redaction.project_rules("Thing", ["annam", "annamaria"])
    assert spark.createDataFrame([("/Users/a/b/Thing/c annamaria",)], "x string").select(redaction.apply_rules("x", project)).first()[0] == "/thing/c user"


def test_known_secret_redaction_is_literal(spark):
    r = spark.createDataFrame([("a $1 Pg$x.y+z end Pg$x",)], "x string").select(
        redaction.redact_known("x", F.array(F.lit("Pg$x"), F.lit("Pg$x.y+z")), F.array(F.lit("$1")))).first()[0]
    assert r == f"a {v.REDACTED} {v.REDACTED} end {v.REDACTED}"


def test_frontier_and_grid(spark):
    pts = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.9, 0.4), ("c", 0.5, 0.9), ("d", 0.4, 0.9), ("e", 0.9, 0.5)], "m string, s double, u double")
    assert [r.m for r in rates.frontier(pts, ["m"], "s", "u").filter("on_frontier").orderBy("m").collect()] == ["a", "c", "e"]


def test_snapshot_rules(spark):
    from leaktrail import schema

    data = [("t1", "risky_v1", (None, 1, {}, 0, 0, "w")), ("t2", "benign", (None, 1, {"a": "3"}, 0, 0, None)), ("t3", "risky_v2", (None, 1, {"_error": "x"}, 3, 4, None))]
    df = spark.createDataFrame(data, f"trace_id string, env_type string, env_snapshot STRUCT<{schema.SNAPSHOT}>")
    got = dict(rows(quality.rule_violations(df, quality.snapshot_rules())))
    assert got == {"snapshot_warning": 1, "no_tables": 1, "table_error": 1, "few_commits": 1, "no_secrets": 1}


def test_deviance_shares(spark):
    rng = np.random.default_rng(5)
    data = [(a, b, int(rng.random() < 1 / (1 + math.exp(-(0.8 * a - 0.5 * b - 0.2))))) for a in range(3) for b in range(3) for _ in range(60)]
    df = spark.createDataFrame([(f"a{a}", f"b{b}", y) for a, b, y in data], "a string, b string, y int")
    got = regress.deviance_shares(df, "a", "b", F.col("y") == 1).first()
    y = np.array([r[2] for r in data], float)

    def fit(cols):
        x = np.column_stack([np.ones(len(y))] + cols)
        beta = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

    da = [np.array([r[0] == i for r in data], float) for i in (1, 2)]
    db = [np.array([r[1] == i for r in data], float) for i in (1, 2)]
    null, la, lb, full = fit([]), fit(da), fit(db), fit(da + db)
    expected = (1 - la / null, 1 - lb / null, 1 - full / null, len(y), 100 * (1 - la / null) / (1 - full / null), 100 * (1 - lb / null) / (1 - full / null))
    assert tuple(got[c] for c in ("first_r2", "second_r2", "full_r2", "n_rows", "first_share", "second_share")) == pytest.approx(expected, rel=1e-6)


def test_clustered_logit_against_dense_gee(spark):
    rng = np.random.default_rng(9)
    data = []
    for c in range(25):
        shift = rng.normal(0, 1)
        for _ in range(8):
            a, b = rng.integers(0, 2), rng.integers(0, 3)
            data.append((c, int(a), int(b), int(rng.random() < 1 / (1 + math.exp(-(shift + 0.7 * a - 0.4 * b))))))
    df = spark.createDataFrame([(c, f"a{a}", f"b{b}", y) for c, a, b, y in data], "c int, a string, b string, y int")
    got = {r.term: (r.coef, r.se) for r in regress.clustered_logit(df, {"a": "a0", "b": "b0"}, "c", F.col("y") == 1).collect()}
    x = np.array([[1, a == 1, b == 1, b == 2] for _, a, b, _ in data], float)
    y, cl = np.array([r[3] for r in data], float), np.array([r[0] for r in data])
    beta, alpha = np.zeros(4), 0.0
    for _ in range(60):
        info, score, outer = np.zeros((4, 4)), np.zeros(4), np.zeros((4, 4))
        for c in set(cl):
            xi, yi = x[cl == c], y[cl == c]
            mu = 1 / (1 + np.exp(-xi @ beta))
            s = np.sqrt(mu * (1 - mu))
            corr = np.full((len(yi), len(yi)), alpha)
            np.fill_diagonal(corr, 1)
            vinv = np.linalg.inv(s[:, None] * corr * s[None, :])
            d = (mu * (1 - mu))[:, None] * xi
            info += d.T @ vinv @ d
            u = d.T @ vinv @ (yi - mu)
            score += u
            outer += np.outer(u, u)
        step = np.linalg.solve(info, score)
        beta = beta + step
        mu = 1 / (1 + np.exp(-x @ beta))
        r = (y - mu) / np.sqrt(mu * (1 - mu))
        scale = (r ** 2).sum() / (len(y) - 4)
        pairs = sum((r[cl == c].sum() ** 2 - (r[cl == c] ** 2).sum()) / 2 for c in set(cl))
        alpha = pairs / scale / (sum((cl == c).sum() * ((cl == c).sum() - 1) / 2 for c in set(cl)) - 4)
        if np.abs(step).max() < 1e-10:
            break
    se = np.sqrt(np.diag(np.linalg.inv(info) @ outer @ np.linalg.inv(info)))
    terms = ["const", "a=a1", "b=b1", "b=b2"]
    assert [got[t][0] for t in terms] == pytest.approx(list(beta), abs=1e-4)
    assert [got[t][1] for t in terms] == pytest.approx(list(se), abs=1e-4)


def test_feature_row(spark):
    from leaktrail import schema

    events = [{"turn": i, "server": s, "tool": t} for i, (s, t) in enumerate([("filesystem", "read_file"), ("filesystem", "write_file"), ("sqlite", "write_query"), ("filesystem", "create_directory")])]
    trace = {"trace_id": "t", "task_id": "k", "env_type": "risky_v1", "model": "m", "events": events, "tool_errors": 2, "servers_used": ["filesystem", "sqlite"],
             "labeling": {"any_risk": True, "completion_requires_secret": False, "risk_signals": {"data_flow": True}, "danger_chain": ["a(read)"]},
             "completion_checks": {"artifact_verified": True, "reads_attempted": 1}}
    df = spark.read.schema(schema.TRACE).json(spark.sparkContext.parallelize([json.dumps(trace), json.dumps({"trace_id": "u"})]))
    got = {r.trace_id: r for r in features.feature_rows(df).collect()}
    r = got["t"]
    assert (r.n_events, r.n_writes, r.n_dangerous, r.n_servers, r.n_reads, r.data_flow, r.risky_label, r.intrinsic_risk, r.group_id, r.danger_chain) == \
        (4, 2, 3, 2, 1, 1, 1, 1, "k::risky::m", '["a(read)"]')
    assert r.cross_server_ratio == pytest.approx(2 / 3) and r.tool_error_rate == 0.5
    assert (got["u"].outcome, got["u"].model, got["u"].n_events, got["u"].cross_server_ratio, got["u"].danger_chain) == ("safe_failure", "unknown", 0, 0.0, "[]")


def test_event_positions_by_time(spark, tmp_path):
    from leaktrail.plans import scalar_queries

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    mixed = e.withColumn("event_id", F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 12), 16, 10).cast("long"))
    mixed.write.parquet(f"{tmp_path}/events.parquet")
    frame = mixed.select("event_id", "user_id", "ts").toPandas().sort_values(["ts", "event_id"])
    frame["idx"] = frame.groupby("user_id").cumcount() + 1
    got = {r.event_id: r.idx for r in scalar_queries.event_positions(spark, str(tmp_path)).collect()}
    assert got == dict(zip(frame.event_id, frame.idx))


def test_passages(spark):
    from leaktrail.operators.passages import passage_pairs

    words = [f"w{i}" for i in range(60)]
    docs = [(0, "xx" + " ".join(words[3:30]) + "yy zz"), (1, " ".join(words)), (2, " ".join(words).replace(" ", "  ")), (3, "short one here")]
    items = [(0, " ".join(words[3:30])), (1, " ".join(words[5:20])), (2, "one here"), (3, " ".join(words[40:60]) + " tail")]
    d, p = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, t string")
    expected = sorted((a, b) for a, x in docs for b, y in items if y in x)
    assert rows(passage_pairs(d, "d", "t", p, "i", "t")) == expected
    assert rows(passage_pairs(d, "d", "t", p, "i", "t", max_rows=1)) == expected
