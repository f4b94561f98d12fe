"""Session settings and the two size-related helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows (checked).
BROADCAST_ROWS = 50_000
#: ... and at most this many characters of content.
BROADCAST_CHARS = 32_000_000

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "leaktrail", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started; clusters have it at the same path."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables and stream checkpoints that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset in local
    mode (tests) a temporary folder of this machine is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="leaktrail-")
    return _LOCAL_DIRS[app]


#: bytecodes up to which HotSpot compiles a method; a longer one is interpreted, however often it runs
COMPILED_METHOD = "8000"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Run with other settings and restore the session's."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def staged(df: DataFrame, name: str, **more: str) -> DataFrame:
    """Write a narrow intermediate once to the shared folder and read it back.

    Several branches then scan a columnar table instead of repeating the work before
    it; a lost executor costs only its own tasks, and the plan after it stays short.
    Stages of many expressions run operator by operator, in methods that HotSpot compiles, not as one that it never does.
    ``more`` are other settings to write it with.
    """
    path = f"{shared_dir(df.sparkSession)}/leaktrail/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, {"spark.sql.codegen.hugeMethodLimit": COMPILED_METHOD, **more}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_groups(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for very many groups that gather lists, one grouping within another.

    Their rows are sorted once, where the hash form gives up after few groups and sorts for each aggregate.
    """
    return staged(df, name, **{"spark.sql.execution.useObjectHashAggregateExec": "false"})


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Measure at most ``max_rows + 1`` rows (count and text size) to decide whether ``df`` may be broadcast."""
    probe = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("c")).first()
    return probe.n <= max_rows and (probe.c or 0) <= max_chars


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the size check passes, else leave the choice to AQE."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df
