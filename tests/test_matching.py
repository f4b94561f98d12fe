"""The automaton, the anchors and both forms of the dictionary join against plain substring tests."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from leaktrail.operators import matching
from leaktrail.operators.anchors import anchor_windows, needle_anchors
from leaktrail.operators.automaton import Matcher, NearMatcher

SCHEMA = "trace_id string, idx int, env_type string, x string"


def texts_and_secrets(seed, kinds="abé😀_"):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(kinds) for _ in range(n))
    secrets = [(f"e{k % 3}", k, "pre_" + word(rnd.choice([1, 4, 12, 25]))) for k in range(30)] + [("e0", 99, "ab"), ("e1", 98, "a\nb é")]
    texts = []
    for i in range(150):
        s = rnd.choice(secrets)[2]
        part = rnd.choice([s, s[:-1], s[1:], s.upper(), s[len(s) // 4:], word(8)])
        texts.append((f"t{i % 7}", i, f"e{rnd.randrange(3)}", word(rnd.randrange(30)) + part + word(rnd.randrange(9))))
    return texts + [("t", 900, "e0", None), ("t", 901, "e0", ""), ("t", 902, None, "ab"), ("t", 903, "e9", "ab")], secrets


def frames(spark, texts, secrets):
    return (spark.createDataFrame(texts, SCHEMA).withColumn("value_of", F.lit(1)),
            spark.createDataFrame(secrets, "env_type string, canary_id int, value string"))


@pytest.mark.parametrize("max_rows", [50_000, 0], ids=["automaton", "anchors"])
def test_containment_and_foreign_matches(spark, max_rows, monkeypatch):
    monkeypatch.setattr(matching, "fits_broadcast", lambda *a, **k: max_rows > 0)
    texts, secrets = texts_and_secrets(1)
    t, d = frames(spark, texts, secrets)
    got = sorted((r.idx, r.canary_id) for r in matching.containment_join(t, d, "x", "env_type").collect())
    assert got == sorted((i, c) for _, i, e, x in texts for e2, c, s in secrets if x and e == e2 and s in x)
    away = sorted((r.idx, r.canary_id, r.home) for r in matching.foreign_matches(t, d, "x").collect())
    assert away == sorted((i, c, e2) for _, i, e, x in texts for e2, c, s in secrets if x and e and e != e2 and s in x)


@pytest.mark.parametrize("max_rows", [50_000, 0], ids=["automaton", "anchors"])
def test_near_matches_need_one_piece(spark, max_rows):
    texts, secrets = texts_and_secrets(2, "abAB")
    t, d = frames(spark, texts, secrets)
    got = sorted((r.idx, r.canary_id, r.other_case, r.long_part) for r in matching.near_matches(t, d, "x", max_rows=max_rows).collect())
    want = []
    for _, i, e, x in texts:
        for e2, c, s in secrets:
            if x and e == e2:
                n = int(len(s) * .7)
                found = s.lower() in x.lower(), n >= 8 and any(s[k:k + n] in x for k in range(len(s) - n + 1))
                want += [(i, c, *found)] if any(found) else []
    assert got == sorted(want) and any(long and not case for *_, case, long in want)


def test_pieces_are_few_and_complete():
    rnd = random.Random(3)
    for _ in range(300):
        s = "".join(rnd.choice("ab") for _ in range(rnd.randrange(12, 90)))
        n = int(len(s) * .7)
        finder = NearMatcher([("e", [s], [s.lower()])])
        assert len(finder.exact.patterns) <= 3
        k = rnd.randrange(len(s) - n + 1)
        assert finder.masks("e", ["x" + s[k:k + n] + "y", ""])[0] == [0, 1]
        short = finder.masks("e", ["x" + s[k:k + n - 1] + "y", ""])
        assert (0 in short) == any(s[j:j + n] in "x" + s[k:k + n - 1] + "y" for j in range(len(s) - n + 1))


def test_matcher_reports_lanes_scopes_and_empty_patterns():
    m = Matcher([("e", ["abc", "b"], ["c"]), ("f", ["abc"], []), ("e", [""], [None])])
    assert m.masks("e", ["xabcx", None, "b", ""]) == {0: [0b101, 0b1], 2: [0b1101, 0]}
    assert m.masks("f", ["xabcx"]) == {1: [1, 0]} and m.masks(None, ["abc"]) == {}
    assert Matcher([]).masks("e", ["abc"]) == {}


def test_anchor_is_the_rarest_window(spark):
    rows = [("e", k, "common_prefix_" + tail) for k, tail in enumerate(["0123456789", "abcdefghij", "zz"])] + [("e", 9, "tiny"), ("e", 10, "")]
    d = spark.createDataFrame(rows, "env_type string, canary_id int, _needle string")
    anchors = needle_anchors(d, ["env_type", "canary_id"], "env_type")
    got = {r.canary_id: r._anchor for r in anchors.collect()}
    assert set(got) == {0, 1, 2, 9} and got[9] == "tiny"
    assert all(len(got[k]) == 10 and got[k] not in "common_prefix_" for k in (0, 1, 2))
    t = spark.createDataFrame([("common_prefix_common_prefix_",), ("xx" + got[1] + "xtiny",), (None,), ("",)], "x string")
    found = [set(r[0]) for r in t.select(anchor_windows(anchors, F.col("x"))).collect()]
    assert {got[1], "tiny"} <= found[1] and not found[2] and not found[3] and len(found[0]) <= 2


def test_entry_survives_a_missing_dependency():
    code = ("import sys; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e\nq = e.queries()\nassert len(q) > 140 and not any(n.startswith('op') and n[2].isdigit() for n in q) and e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_the_view_reads_the_events_once(spark):
    """Its dimensions are stored once a session; before, naming them in a SQL text gave the kept frames up and each use read all events again."""
    from leaktrail.plans.views import secret_dictionary, tool_events

    sf = "/root/testdata/sf0.001"
    secret_dictionary(spark, sf)
    for df in (tool_events(spark, sf), secret_dictionary(spark, sf)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("props#" in line and "Relation" in line for line in plan.splitlines()) == (1 if "idx" in df.columns else 0)


def test_unescaped_texts_and_privileged_values(spark):
    from leaktrail.functions import text as t

    rows = [("a", r"x\_y\.z"), ("b", "x_y"), ("c", None), ("d", ""), ("e", r"\\_"), ("f", "role 'Admin' IS_ADMIN = 1"), ("g", "all")]
    df = spark.createDataFrame(rows, "k string, x string")
    got = {r.k: (r.p, r.v) for r in df.select("k", t.strip_md("x").alias("p"), t.privileged_values("x").alias("v")).collect()}
    assert got["a"] == ("x_y.z", []) and got["b"] == ("x_y", []) and got["c"] == (None, None) and got["d"] == ("", []) and got["e"] == (r"\_", [])
    assert got["f"][1] == ["'admin'", "is_admin = 1"] and got["g"][1] == []


def test_spread_counts_rows_not_splits(spark, tmp_path):
    """A file of one row group has many splits and rows in one of them; before, the number of splits decided."""
    from leaktrail.plans.registry import spread

    path = str(tmp_path / "one.parquet")
    spark.range(4000).selectExpr("id", "sha2(cast(id as string), 256) AS x").coalesce(1).write.parquet(path)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 8
        out = spread(df)
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 4000 and max(held) <= 4000 / 4
        even = spark.range(4000).repartition(8)
        assert spread(even) is even and spread(spark.range(0)).count() == 0
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)


def test_matcher_reads_a_batch_as_one(monkeypatch):
    """Every text of every row was given to the automaton by itself, and its answers were put together in Python."""
    import pyarrow as pa

    from leaktrail.operators import automaton

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé😀") for _ in range(rnd.randrange(n)))
    for _ in range(60):
        monkeypatch.setattr(automaton, "RUN_BYTES", rnd.choice([1, 5, 40, 4_000_000]))
        rows = [(rnd.choice(["e", "f", None]), [rnd.choice([word(5), None]) for _ in range(rnd.randrange(3))], [word(4)]) for _ in range(rnd.randrange(8))]
        m = Matcher(rows, rnd.random() < 0.3)
        n, skipped = rnd.randrange(20), rnd.randrange(3)
        scopes = [rnd.choice(["e", "f", "g", None]) for _ in range(n)]
        lanes = [[None if rnd.random() < 0.2 else word(9) for _ in range(n)] for _ in range(3)]
        ends, (numbers, *masks) = m.batch(pa.array(scopes, pa.string()), [pa.array(["ab"] * skipped + x, pa.string()).slice(skipped) for x in lanes])
        got = [{int(numbers[j]): [int(x[j]) for x in masks] for j in range(ends[i], ends[i + 1])} for i in range(n)]
        assert got == [m.masks(s, [x[i] for x in lanes]) for i, s in enumerate(scopes)]


def test_matcher_leaves_out_what_lies_across_two_texts():
    import pyarrow as pa

    ends, (numbers, values) = Matcher([("e", ["ab"])]).batch(pa.array(["e"] * 4), [pa.array(["xa", "b", "", "éab"])])
    assert list(ends) == [0, 0, 0, 0, 1] and list(numbers) == [0] and list(values) == [1]


def test_the_view_reads_each_json_key_once(spark):
    """The join's filter on k read the JSON a second time, in every scan of the events."""
    from leaktrail.plans.views import tool_events

    plan = tool_events(spark, "/root/testdata/sf0.001").select("idx", "tool")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(props") == 1
