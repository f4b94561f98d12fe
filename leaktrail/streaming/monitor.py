"""Run monitor, resume and windowed counts over streams of traces and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v
from leaktrail.operators import monitor as m
from leaktrail.streaming.guard import run_once


def monitor_stream(traces: DataFrame, run: str, order: str, bucket: Column, path: str, checkpoint: str, token_budget: int = 0,
                   available_now: bool = True):
    """Monitor a stream of traces.

    Each micro-batch runs the batch monitor (bucket-wise, so one busy run is not one
    task) on top of the state its predecessor left: a dozen numbers per run. State and
    output are stored under their batch number, so a replayed batch overwrites its own
    result and reads the same state: the outcome is exactly once.
    """
    spark = traces.sparkSession

    def state_of(batch: int) -> str:
        return f"{path}/state/batch={batch}"

    def step(df: DataFrame, batch: int) -> None:
        state = spark.read.parquet(state_of(batch - 1)) if batch > 0 else None
        out = m.monitor(df, run, order, bucket, token_budget, state)
        out.write.mode("overwrite").parquet(f"{path}/traces/batch={batch}")
        done = spark.read.parquet(f"{path}/traces/batch={batch}")
        new = m.carry(done, run, order)
        if state is not None:  # runs without new traces keep their state
            new = new.unionByName(state.join(new.select(run), run, "left_anti"))
        new.write.mode("overwrite").parquet(state_of(batch))

    writer = traces.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def monitored(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/traces")


def periodic_validation_stream(traces: DataFrame, run: str, order: str, bucket: Column, path: str, checkpoint: str):
    """Validate a stream of traces (``operators.monitor.validation_input``) at the checkpoints it reaches.

    What goes from batch to batch is a ring of the last traces of every run, as many as the longest window needs. A
    batch numbers its traces behind the ring, judges the checkpoints it completes under ``health`` and gives each new
    trace the tokens of its window under ``tokens``. Ring and results are stored under the batch's number, so a replay
    overwrites its own.
    """
    spark, kept = traces.sparkSession, max(v.TOKEN_TRACES, v.EARLY_TRACES)

    def step(df: DataFrame, batch: int) -> None:
        new = m.with_position(df, run, order, bucket)
        if batch > 0:
            ring = spark.read.parquet(f"{path}/ring/batch={batch - 1}")
            done = ring.groupBy(run).agg(F.max("pos").alias("_done"))
            new = new.join(done, run, "left").withColumn("pos", F.col("pos") + F.coalesce("_done", F.lit(0))).drop("_done")
        new.write.mode("overwrite").parquet(f"{path}/new/batch={batch}")
        new = spark.read.schema(new.schema).parquet(f"{path}/new/batch={batch}")
        rows = new if batch == 0 else new.unionByName(ring)
        first = new.groupBy(run).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
        health = m.periodic_validation(rows, run).join(first, run).filter(F.col("checkpoint") >= F.col("_first")).drop("_first", "_last")
        health.write.mode("overwrite").parquet(f"{path}/health/batch={batch}")
        tokens = m.recent_tokens(rows, run).join(first, run).filter(F.col("pos") >= F.col("_first"))
        tokens.select(run, order, "pos", "recent_tokens", "recent_traces").write.mode("overwrite").parquet(f"{path}/tokens/batch={batch}")
        last = rows.join(first, run, "left").filter(F.col("_last").isNull() | (F.col("pos") > F.col("_last") - kept))
        last.select(*new.columns).write.mode("overwrite").parquet(f"{path}/ring/batch={batch}")

    return traces.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def validation_stream(traces: DataFrame, order: str, path: str, checkpoint: str, last: int):
    """Health of the last traces after every micro-batch (``traces`` carry their events)."""
    from leaktrail.sources.logs import explode_events

    def step(df: DataFrame, batch: int) -> None:
        health = m.recent_health(df, explode_events(df), order, last)
        health.withColumn("batch", F.lit(batch)).write.mode("overwrite").json(f"{path}/batch={batch}")

    return traces.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_traces(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each trace id once, with state bounded by the watermark; traces without events are left for a later attempt."""
    return stream.filter(F.size("events") > 0).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def failure_stop(attempts: DataFrame, run: str, order: str, bucket: Column, limit: int) -> DataFrame:
    """First attempt of each run that completes ``limit`` consecutive failures."""
    lengths = m.run_length(attempts, [run], order, bucket, F.col("failed"), "failures")
    return lengths.filter(F.col("failures") >= limit).groupBy(run).agg(F.min(order).alias("stop_at"))


def window_counts(events: DataFrame, ts: str, length: str, slide: str | None, delay: str, leak: Column, keys: list[str]) -> DataFrame:
    """Calls and leaks per event-time window; ``run_with_late`` keeps the rows behind the watermark for ``late_windows``."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(leak).alias("n_leaks"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "n_leaks"))


def sessions(events: DataFrame, ts: str, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of a trace, closed by a pause of ``gap``; ``late_sessions`` adds the rows behind the watermark."""
    return (events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def split_late(batch: DataFrame, ts: str, horizon) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch against the horizon of the batches before it; rows without a time count as late."""
    late = F.col(ts).isNull() | (F.col(ts) < F.lit(horizon) if horizon is not None else F.lit(False))
    return batch.filter(~late), batch.filter(late)


def _done(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def run_with_late(rows: DataFrame, ts: str, delay: str, build: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Run the stateful query ``build`` over a stream and keep what its watermark would drop.

    Each micro-batch is split at the horizon (latest time of the batches before it, less
    ``delay``): rows behind it are stored in a late table, the others are handed to the
    stateful query as one micro-batch of its own, so its watermark is never ahead of the
    horizon. Batches are stored under their number and written once, so a replay feeds
    nothing twice. Gives (output, rows on time, late rows, final horizon).
    """
    spark = rows.sparkSession
    feed = spark.readStream.schema(rows.schema).parquet(f"{path}/on_time/batch=*")

    def times(batch) -> DataFrame:
        return spark.read.schema("latest timestamp").parquet(f"{path}/latest/batch={batch}")

    def horizon(batch) -> int | None:
        return times(batch).agg(F.unix_micros(F.max("latest") - F.expr(f"INTERVAL {delay}"))).first()[0]

    def step(df: DataFrame, batch: int) -> None:
        before = horizon(batch - 1) if batch > 0 else None
        # a row at the watermark is dropped too, so it counts as late
        on_time, late = split_late(df, ts, F.timestamp_micros(F.lit(before + 1)) if before is not None else None)
        so_far = df.agg(F.max(ts).alias("latest"))
        if batch > 0:
            so_far = so_far.unionByName(times(batch - 1)).agg(F.max("latest").alias("latest"))
        for name, part in (("late", late), ("latest", so_far), ("on_time", on_time)):
            if not _done(spark, f"{path}/{name}/batch={batch}"):
                part.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        run_once(build(feed), f"{path}/out", f"{path}/checkpoint")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/landing").trigger(availableNow=True).start().awaitTermination()

    def stored(name):
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}/batch=*")

    out = spark.read.schema(build(feed).schema).parquet(f"{path}/out")
    return out, stored("on_time"), stored("late"), F.timestamp_micros(F.lit(horizon("*")))


def late_windows(closed: DataFrame, late: DataFrame, ts: str, length: str, slide: str | None, horizon: Column, leak: Column, keys: list[str]) -> DataFrame:
    """Closed windows with the counts of the late rows added; windows still open at the horizon stay out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    more = (late.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(leak).alias("n_leaks"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "n_leaks").filter(F.col("end") <= horizon))
    return closed.unionByName(more).groupBy("start", "end", *keys).agg(F.sum("n").alias("n"), F.sum("n_leaks").alias("n_leaks"))


def late_sessions(closed: DataFrame, on_time: DataFrame, late: DataFrame, ts: str, gap: str, horizon: Column, key: str) -> DataFrame:
    """Closed sessions; a late row can join or lengthen sessions, so keys with late rows are cut anew from all their rows."""
    touched = late.select(key).distinct()
    again = (on_time.unionByName(late).join(touched, key, "left_semi").groupBy(F.session_window(ts, gap).alias("w"), key)
             .agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))
    return closed.join(touched, key, "left_anti").unionByName(again.filter(F.col("end") <= horizon))


def late_ids(stored: DataFrame, late: DataFrame, key: str, ts: str) -> DataFrame:
    """The stored ids and the late rows whose id is not stored yet, one row per id."""
    first = [F.min_by(c, F.struct(F.col(ts).isNull(), F.col(ts))).alias(c) for c in stored.columns if c != key]
    return stored.unionByName(late.select(*stored.columns).join(stored.select(key), key, "left_anti")).groupBy(key).agg(*first)
