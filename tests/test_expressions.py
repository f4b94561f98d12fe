"""Row-level expressions against plain Python or known values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.functions import outcome as o
from leaktrail.functions import stats
from leaktrail.functions import text as t
from leaktrail.functions.secrets import secret_core, secret_fragments


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", expr.alias("y")).orderBy("i").collect()]


def test_network_commands(spark):
    yes = ["/usr/bin/curl x", "a && curl b", "$(wget u)", "nc h", "CURL x", "curl\tx", "x|ssh h", "sftp"]
    no = ["curlew", "sshd", "ncurses", "python script.py", "ls", ""]
    assert column(spark, yes + no, t.is_network_command("x")) == [True] * len(yes) + [False] * len(no)


def test_markdown_strip_on_json_equals_strip_on_values(spark):
    import json
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab_\\*[]()~`>#+-=|{}.!\"'\n é$") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    plain = lambda s: re.sub(r"\\([_*\[\]()~`>#+\-=|{}.!])", r"\1", s)
    assert column(spark, texts, t.strip_md("x")) == [plain(s) for s in texts]
    as_json = [json.dumps({"a": s}, ensure_ascii=False) for s in texts]
    assert column(spark, as_json, t.strip_md_json("x")) == [json.dumps({"a": plain(s)}, ensure_ascii=False) for s in texts]


@pytest.mark.parametrize("value,core", [
    ("sk_live_abcdefghij12", "abcdefghij12"), ("sk_live_short", "live_short"[-10:]), ("xoxb-123-abcdefghijkl", "abcdefghijkl"), ("123-45-6789", "23-45-6789"),
    ("admin-ops7k@internal.corp", "admin-ops7k@internal"), ("a@b.c", "@b.c"), ("wJa7rXUt9FEm3K5MDe8G/bPx1RfC6Y", "FEm3K5MDe8G/bPx1RfC6Y"),
    ("wJa7rXUt9FEm3K5MDe8G99/bPx1RfC6Yzz", "bPx1RfC6Yzz"), ("Pg$ecure_xK9mR2nT4vQ8wZb", "re_xK9mR2nT4vQ8wZb"[-16:]), ("12345678", "45678"), ("abcde", "bcde"), ("abc", "abc")])
def test_core(spark, value, core):
    assert column(spark, [value], secret_core("x")) == [core]


def test_fragments(spark):
    got = column(spark, ["xoxb-1234567890-abcdefghijkl", "123-45-6789", "longlocalpart@host.example"],
                 secret_fragments("x", secret_core("x")))
    assert got == [["abcdefghijkl", "1234567890"], ["23-45-6789"], ["longlocalpart@host", "longlocalpart"]]


def test_flags_and_text_rules(spark):
    assert column(spark, ["true", "True", "1", None, "false"], t.is_flag("x")) == [True, True, False, False, False]
    assert column(spark, ["exit_code: 2\nx", "exit_code: 0", "no", "exit_code: x"], t.exit_code("x")) == [2, 0, None, None]
    assert column(spark, ['a {"b": {"c": 1}} z', "none"], t.first_json_object("x")) == ['{"b": {"c": 1}}', None]
    assert column(spark, ["risky_v9", "hard_neg_v1", "benign", "x"], t.env_class("x")) == ["risky", "hard_neg", "benign", "unknown"]
    assert column(spark, ["cp -r project_alpha", "cp -r project_alpha/", "cp -r project_alpha/.env x", "cp -r project_alpha2", "cp -r 'project_alpha' d", "cp -r project_alpha/src x"],
                  t.copies_sensitive_root("x")) == [True, True, True, False, True, False]


def test_outcomes(spark):
    rows = spark.createDataFrame([(True, False), (True, True), (False, False), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in rows.select(o.quadrant("a", "b")).collect()] == v.OUTCOMES[:2] + v.OUTCOMES[2:]
    assert column(spark, [None, "", " NONE ", "taint_tracking"], o.is_no_defense("x")) == [True, True, True, False]
    assert column(spark, ["generic", "old", None], o.mitigation_level("x", F.lit(True))) == ["generic", "moderate", "moderate"]


def choose(n, k):
    return math.comb(n, k)


def hyper(x, row, col, n):
    return choose(col, x) * choose(n - col, row - x) / choose(n, row)


def counts(spark, rows, *exprs):
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_log_factorial(spark):
    got = column(spark, [0, 1, 5, 20, 21, 50, 1000, 10**6], stats.log_factorial("x"), "bigint")
    assert got == pytest.approx([math.lgamma(n + 1) for n in (0, 1, 5, 20, 21, 50, 1000, 10**6)], rel=1e-13)


def test_exact_tests(spark):
    rows = [(3, 7, 9, 1), (0, 5, 5, 0), (10, 10, 12, 8), (0, 0, 3, 4), (1, 200, 30, 170)]
    got = counts(spark, rows, stats.fisher_exact("a", "b", "c", "d"), stats.mcnemar_exact("a", "b"), stats.permutation_p("a", F.col("a") + F.col("b"), "c", F.col("c") + F.col("d")))
    for (a, b, c, d), (fisher, mcnemar, perm) in zip(rows, got):
        row, col, n = a + b, a + c, a + b + c + d
        support = range(max(0, row + col - n), min(row, col) + 1)
        seen = hyper(a, row, col, n)
        assert fisher == pytest.approx(min(1, sum(p for p in (hyper(x, row, col, n) for x in support) if p <= seen * (1 + 1e-7))), abs=1e-9)
        m = a + b
        expected = 1.0 if m == 0 else min(1.0, 2 * sum(choose(m, i) for i in range(min(a, b) + 1)) / 2**m)
        assert mcnemar == pytest.approx(expected, abs=1e-9)
        if row and c + d:
            gap = abs(a / row - c / (c + d))
            p = sum(hyper(x, row, col, n) for x in support if abs(x / row - (col - x) / (n - row)) >= gap - 1e-12)
            assert perm == pytest.approx(min(1, p), abs=1e-9)


def test_finite_population_interval(spark):
    rows = [(3, 150, 698, 0), (8, 150, 698, 0), (0, 10, 40, 0), (10, 10, 40, 0), (2, 20, 20, 0)]
    lo, hi = stats.hypergeometric_interval("a", "b", "c")
    for (k, n, pool, _), (a, b) in zip(rows, counts(spark, rows, lo, hi)):
        up = [sum(hyper(x, n, big, pool) for x in range(max(k, n + big - pool, 0), min(n, big) + 1)) for big in range(pool + 1)]
        down = [sum(hyper(x, n, big, pool) for x in range(max(0, n + big - pool), min(k, big) + 1)) for big in range(pool + 1)]
        assert a == pytest.approx(next(i for i, p in enumerate(up) if p > 0.025) / pool)
        assert b == pytest.approx(max(i for i, p in enumerate(down) if p > 0.025) / pool)


def test_tango(spark):
    def score(t, n, b, c):
        lin = -b - c + (2 * n - b + c) * t
        q = (math.sqrt(max(0, lin * lin + 8 * n * c * t * (1 - t))) - lin) / (4 * n)
        var = n * (2 * q + t * (1 - t))
        return (b - c - n * t) / math.sqrt(var) if var > 0 else 0.0

    rows = [(100, 30, 10, 0), (20, 5, 0, 0), (50, 0, 0, 0), (12, 12, 0, 0), (12, 0, 12, 0)]
    lo, hi = stats.tango("a", "b", "c")
    for (n, b, c, _), (x, y) in zip(rows, counts(spark, rows, lo, hi)):
        assert -1 <= x <= (b - c) / n <= y <= 1
        if -1 < x:
            assert score(x, n, b, c) == pytest.approx(v.Z95, abs=1e-5)
        if y < 1:
            assert score(y, n, b, c) == pytest.approx(-v.Z95, abs=1e-5)
    assert counts(spark, [(12, 12, 0, 0)], hi) == [(1.0,)] and counts(spark, [(12, 0, 12, 0)], lo) == [(-1.0,)]


def test_normal_functions(spark):
    xs = [-6.0, -3.0, -1.0, 0.0, 0.5, 1.96, 2.99, 3.01, 5.0]
    assert column(spark, xs, stats.normal_cdf("x"), "double") == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-12)
    assert column(spark, [0.025, 0.5, 0.975], stats.normal_quantile("x"), "double") == pytest.approx([-1.96, 0, 1.96], abs=1e-3)


def test_wilson_conventions(spark):
    assert [x for x in counts(spark, [(0, 0, 0, 0)], *stats.wilson("a", "b"), *stats.wilson("a", "b", v.Z95_SHORT, (0.0, 0.0)), stats.wilson_text("a", "b"))] == [(0.0, 1.0, 0.0, 0.0, "[n/a]")]
    (lo, hi), = counts(spark, [(3, 12, 0, 0)], *stats.wilson("a", "b"))
    assert (round(lo, 4), round(hi, 4)) == (0.0889, 0.5323)


def test_network_pattern_holds_for_every_prefix(spark):
    """The prefixes were looked for one by one, each in a text lowered anew."""
    from leaktrail import vocab as v

    yes = [start + p + "x" for p in v.NETWORK_PREFIXES for start in ("", "a ", "A  ")] + [p.upper() for p in v.NETWORK_PREFIXES]
    assert column(spark, yes, t.is_network_command("x")) == [True] * len(yes)


def test_word_lists_take_a_lowered_text(spark):
    texts = ["CAT /ws/.ENV", "cp x", "/ws/Deploy.SH", "role 'ADMIN'", "Is_Admin = 1", "a_b", "", None]
    pairs = [(t.is_shell_read, "x"), (t.is_sensitive_path, "x"), (t.has_sensitive_column, "x"), (t.is_copy_command, "x"), (t.is_executable_path, "x")]
    for rule, x in pairs:
        assert column(spark, texts, rule(x)) == column(spark, texts, rule(F.lower(x), True))
    assert column(spark, texts, t.privileged_values("x")) == [[], [], [], ["'admin'"], ["is_admin = 1"], [], [], None]
