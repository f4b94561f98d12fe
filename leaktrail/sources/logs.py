"""Readers and writers of trace logs, annotation sheets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from leaktrail import schema, vocab as v
from leaktrail.operators.grouped import first_wins
from leaktrail.operators.quality import require_empty


def read_envelopes(spark: SparkSession, paths, pattern: str = "agent_traces*.json") -> DataFrame:
    """Traces of all matching JSON files, envelope or bare list, with header columns, file and position.

    Whole-file documents cannot be split, so a file is one task; keep files small or
    use the line or parquet form for large logs. Corrupt files yield no traces.
    """
    bare = F.from_json("text", f"ARRAY<STRUCT<{schema.TRACE}>>")
    wrapped = F.from_json("text", schema.ENVELOPE)
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(paths)
             .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
             .filter(~F.contains("file", F.lit(".checkpoint."))))
    is_list = F.ltrim("text").startswith("[")
    parsed = files.select("file", F.when(~is_list, wrapped).alias("e"), F.when(is_list, bare).alias("l"))
    rows = parsed.select("file", *[F.col(f"e.{h}").alias(h) for h in schema.HEADER],
                         F.posexplode(F.coalesce("l", F.col("e.traces"))).alias("pos", "t"))
    return rows.select("t.*", *schema.HEADER, "file", "pos")


def load_traces(spark: SparkSession, paths, model: str | None = None, pattern: str = "agent_traces*.json") -> DataFrame:
    """All traces, first one wins per (model, trace_id) in path order."""
    rows = read_envelopes(spark, paths, pattern)
    if model:
        rows = rows.filter(F.col("model") == model)
    rows = rows.withColumn("model", F.coalesce("model", F.lit(""))).withColumn("trace_id", F.coalesce("trace_id", F.lit("")))
    return first_wins(rows, ["model", "trace_id"], ["file", "pos"])


LINE_ORDER = ["_file", "_split", "_at"]


def read_lines(spark: SparkSession, paths, pattern: str = "*.jsonl", ordered: bool = False) -> DataFrame:
    """JSON lines (splittable); malformed lines and traces without events are dropped.

    ``ordered`` adds ``LINE_ORDER``: path, start of the split and a number that rises within it. However Spark packs
    the files into tasks, these order the lines by path and line.
    """
    rows = (spark.read.schema(schema.TRACE).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).json(paths))
    if ordered:
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                           F.monotonically_increasing_id().alias("_at"))
    return rows.filter(F.size("events") > 0)


def load_all(spark: SparkSession, directories: list[str], fallback_lines: bool = True) -> DataFrame:
    """Union of log directories; JSON lines are used only when no trace file has rows (last one wins there)."""
    main = load_traces(spark, directories)
    if not fallback_lines or not main.isEmpty():
        return main
    return first_wins(read_lines(spark, directories, ordered=True), ["trace_id"], LINE_ORDER, last=True).drop(*LINE_ORDER)


def resume(main: DataFrame, appended: DataFrame) -> DataFrame:
    """Main traces with events, plus appended ones whose id is new and that have events.

    Of appended traces with one id the first wins; ``appended`` needs ``LINE_ORDER`` for that (``read_lines(ordered=True)``),
    without it rows of one id must be equal.
    """
    def valid(df):
        return df.filter(F.size("events") > 0)

    kept = valid(main)
    new = valid(appended).filter(F.coalesce("trace_id", F.lit("")) != "").join(kept.select("trace_id"), "trace_id", "left_anti")
    once = first_wins(new, ["trace_id"], LINE_ORDER).drop(*LINE_ORDER) if set(LINE_ORDER) <= set(new.columns) else new.dropDuplicates(["trace_id"])
    return kept.unionByName(once, allowMissingColumns=True)


def load_arm(spark: SparkSession, path: str, defense: str, pattern: str = "*.json") -> DataFrame:
    """One arm with its header; every trace must carry the expected defense and no mitigation."""
    arm = read_envelopes(spark, path, pattern)
    wrong = arm.filter(~F.coalesce((F.col("defense") == defense) & (F.col("mitigation_level") == "none"), F.lit(False)))
    require_empty(wrong.select("trace_id", "defense", "mitigation_level"), f"arm is not uniformly defense={defense!r}")
    if arm.isEmpty():
        raise ValueError(f"{path}: no traces")
    return arm


def explode_events(traces: DataFrame) -> DataFrame:
    """Events as rows; the position in the trace is ``idx``, the time axis of all flow logic."""
    return traces.select("trace_id", "model", "env_type", F.posexplode("events").alias("idx", "e")).select(
        "trace_id", "model", "env_type", F.col("idx").cast("bigint").alias("idx"), "e.*")


def _streamed_sha256(spark: SparkSession, path: str) -> Column:
    """SHA-256 of the bytes of the file that column ``path`` names, read by the executor through a small buffer.

    Spark has no function that reads a file piece by piece, so its own expressions call Hadoop's ``open`` and the digest
    over the stream. Any file system of the session works; the stream is closed at its end.
    """
    jvm = spark._jvm
    catalyst, types, column = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types, jvm.org.apache.spark.sql.classic.ExpressionUtils
    seq, none = jvm.PythonUtils.toSeq, jvm.scala.Option.empty()

    def java(name):
        return jvm.java.lang.Class.forName(name)

    def kind(name):
        return types.ObjectType(java(name))

    def call(target, method, returns, *args):
        return catalyst.objects.Invoke(target, method, kind(returns), seq(list(args)), seq([]), True, True, True)

    def static(name, method, returns, *args):
        return catalyst.objects.StaticInvoke(java(name), returns, method, seq(list(args)), seq([]), True, True, True, none)

    def new(name, *args):
        return catalyst.objects.NewInstance(java(name), seq(list(args)), seq([]), True, kind(name), none)

    held = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(catalyst.Literal(held, kind("org.apache.spark.util.SerializableConfiguration")), "value", "org.apache.hadoop.conf.Configuration")
    file = new("org.apache.hadoop.fs.Path", call(column.expression(F.col(path)._jc), "toString", "java.lang.String"))
    stream = call(call(file, "getFileSystem", "org.apache.hadoop.fs.FileSystem", conf), "open", "org.apache.hadoop.fs.FSDataInputStream", file)
    closing = new("org.apache.commons.io.input.AutoCloseInputStream", stream)
    digest = static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex", kind("java.lang.String"), closing)
    return ClassicColumn(column.column(static("org.apache.spark.unsafe.types.UTF8String", "fromString", types.DataTypes.StringType, digest)))


def file_digests(spark: SparkSession, paths) -> DataFrame:
    """Path, length and SHA-256 of each file. One task reads a file, as its digest needs the bytes in order; memory does not grow with the file."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", _streamed_sha256(spark, "path").alias("sha256"))


def parse_label(raw) -> Column:
    x = F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw))
    return F.when(x.isin(v.TRUE_TOKENS), True).when(x.isin(v.FALSE_TOKENS), False)


def sheet_violations(sheet: DataFrame, label: str = "your_crs_label") -> DataFrame:
    """Blank or duplicate ids, blank or unknown labels."""
    tid = F.trim(F.coalesce("task_id", F.lit("")))
    raw = F.trim(F.coalesce(label, F.lit("")))
    problem = F.when(tid == "", "blank id").when(raw == "", "blank label").when(parse_label(label).isNull(), "unknown label")
    single = sheet.select(tid.alias("task_id"), problem.alias("problem")).filter("problem IS NOT NULL")
    twice = sheet.groupBy(tid.alias("task_id")).count().filter("count > 1").select("task_id", F.lit("duplicate id").alias("problem"))
    return single.unionByName(twice)


def read_sheet(spark: SparkSession, path: str, label: str = "your_crs_label") -> DataFrame:
    """Annotation sheet as (task_id, label); any violation is fatal."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in ("task_id", label) if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    sheet = spark.read.option("header", True).option("multiLine", True).csv(path)
    require_empty(sheet_violations(sheet, label), path)
    if sheet.isEmpty():
        raise ValueError(f"{path}: no rows")
    return sheet.select(F.trim("task_id").alias("task_id"), parse_label(label).alias("label"))


def read_regression(spark: SparkSession, path: str, non_crs_only: bool = True) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    wanted = [p.split(" ")[0] for p in schema.REGRESSION.split(", ")]
    missing = sorted(set(wanted) - set(header))
    if missing:
        raise ValueError(f"missing columns {missing}")
    casts = dict(p.split(" ") for p in schema.REGRESSION.split(", "))
    df = spark.read.option("header", True).csv(path).select(*[F.col(c).cast(casts[c]) for c in wanted])
    return df.filter("is_crs = 0") if non_crs_only else df


def with_header(df: DataFrame, header: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(val) for k, val in header.items()})


def write_log(df: DataFrame, path: str, header: dict[str, str], mode: str = "errorifexists") -> None:
    """Versioned log, partitioned for the common filters; the committer makes the write all-or-nothing."""
    from leaktrail.functions.text import env_class

    with_header(df, header).withColumn("env_class", env_class("env_type")).write.mode(mode).partitionBy(
        "model", "env_class").parquet(path)


def write_envelopes(traces: DataFrame, path: str, header: dict[str, str], per_file: int = 500) -> None:
    """Versioned envelopes of one model each, about ``per_file`` traces a file; the committer makes the write all-or-nothing.

    A model's traces are dealt by a hash of their id, so no row holds all of a busy model. Read back with
    ``read_envelopes(spark, path, "part-*")``.
    """
    counts = traces.groupBy(F.col("model").alias("_model")).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_file)).alias("_files"))
    dealt = traces.join(counts, F.col("model").eqNullSafe(F.col("_model")))
    known = [f for f in spark_fields(schema.TRACE) if f in traces.columns]
    files = (dealt.withColumn("_file", F.pmod(F.xxhash64("trace_id"), F.col("_files")))
             .groupBy("model", "_file").agg(F.collect_list(F.struct(*known)).alias("traces")))
    head = [F.lit(header[h]).alias(h) for h in schema.HEADER if h in header]
    (files.select(F.to_json(F.struct(*head, "traces")).alias("value"))
     .write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path))


def spark_fields(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append-only log of a stream, exactly once through its checkpoint."""
    return (stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def write_points(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report tables are never overwritten."""
    df.write.mode("errorifexists").json(path)


def write_sanitized(raw: DataFrame, key: str, text: str, protected: list[str], path: str, rules=None) -> DataFrame:
    """Cleaned rows that changed and pass every check go to ``path``; the violations come back."""
    from leaktrail.operators.redaction import clean, release_violations

    cleaned = clean(raw, text, rules)
    bad = release_violations(raw, cleaned, key, protected)
    (cleaned.filter("changed").join(bad.select(key).distinct(), key, "left_anti")
     .write.mode("errorifexists").parquet(path))
    return bad
