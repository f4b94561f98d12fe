"""Periodic validation and token windows against plain loops, and their stream against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from leaktrail.operators import monitor as m
from leaktrail.streaming import monitor as sm

SCHEMA = ("run string, at bigint, trace_id string, mechanism string, total_tokens bigint, "
          "called array<struct<server string, total bigint, errors bigint, empty bigint>>")


def made_traces(seed, n=130):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        called = [(s, 3, rnd.choice([0, 1, 3, 3]), rnd.choice([0, 0, 2])) for s in ("git", "sqlite", "shell", "browser") if rnd.random() < .3]
        out.append((rnd.choice(["a", "a", "b", "c"]), i, f"t{i}", rnd.choice(["git_history_leak", "other"]), rnd.randrange(100), called))
    return out + [("short", n + k, f"s{k}", "other", 1, []) for k in range(4)]


def judged(traces):
    health, tokens = [], []
    for run in {t[0] for t in traces}:
        mine = sorted((t for t in traces if t[0] == run), key=lambda t: t[1])
        tokens += [(run, t[1], k + 1, sum(x[4] for x in mine[max(0, k - 19):k + 1]), min(k + 1, 20)) for k, t in enumerate(mine)]
        for n in range(1, len(mine) + 1):
            if n != 5 and n % 20:
                continue
            seen, last = {}, mine[n - 5:n]
            for t in last:
                for s, total, errors, empty in t[5]:
                    seen[s] = tuple(map(sum, zip(seen.get(s, (0, 0, 0)), (total, errors, empty))))
            bad = sorted(s for s, (total, errors, _) in seen.items() if s not in ("browser", "shell") and errors / total > .5 and errors >= 3)
            empty = "git" in seen and seen["git"][2] / seen["git"][0] > .3
            tasks = [t for t in last if t[3] == "git_history_leak"]
            unused = len(tasks) >= 2 and not any(c[0] == "git" for t in tasks for c in t[5])
            health.append((run, n, 5, "+".join(bad), empty, unused, not bad and not empty and not unused))
    return sorted(health), sorted(tokens)


@pytest.mark.parametrize("width", [7, 1000])
def test_validation_against_a_loop(spark, width):
    rows = made_traces(width)
    positioned = m.with_position(spark.createDataFrame(rows, SCHEMA), "run", "at", F.floor(F.col("at") / width))
    health, tokens = judged(rows)
    assert sorted(map(tuple, m.periodic_validation(positioned, "run").collect())) == health
    assert any(h[5] for h in health) and any(h[3] for h in health) and any(h[6] for h in health) < len(health)
    for block in (23, 100_000):
        got = m.recent_tokens(positioned, "run", block=block).select("run", "at", "pos", "recent_tokens", "recent_traces")
        assert sorted(map(tuple, got.collect())) == tokens


def test_validation_stream_keeps_its_ring_over_batches(spark, tmp_path):
    """Five batches of two files each; runs pause for whole batches and start late."""
    rows = made_traces(3)
    cuts = [0, 3, 40, 41, 100, 10**6]
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if low <= r[1] < high and not (r[0] == "b" and i in (1, 2))]
        rows = [r for r in rows if not (low <= r[1] < high and r[0] == "b" and i in (1, 2))]
        for k in (0, 1):
            spark.createDataFrame(part[k::2], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}{k}")
        sm.periodic_validation_stream(stream, "run", "at", F.floor(F.col("at") / 30), str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination()
    health, tokens = judged(rows)
    got = spark.read.parquet(f"{tmp_path}/o/health/batch=*").select("run", "checkpoint", "n_traces", "failing_servers", "git_empty", "git_unused", "healthy")
    assert sorted(map(tuple, got.collect())) == health
    got = spark.read.parquet(f"{tmp_path}/o/tokens/batch=*").select("run", "at", "pos", "recent_tokens", "recent_traces")
    assert sorted(map(tuple, got.collect())) == tokens
    assert spark.read.parquet(f"{tmp_path}/o/ring/batch=4").groupBy("run").count().agg(F.max("count")).first()[0] <= 20
