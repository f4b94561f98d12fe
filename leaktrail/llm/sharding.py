"""Sharding by a two-pass external shuffle (operator 6, DataFrame functions only).

First pass: every record goes to one of M buckets by a seeded hash, M chosen so that a
bucket fits in memory. Second pass: each bucket is put in hash order and Fisher-Yates
shuffled by itself. The buckets one after the other are a random order of all records; the
record at position p goes to shard p mod S, slot p div S, so counts are at most one apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SHARDS = 40
SEED = 42
#: Bytes of text (16 more a row) that one bucket should hold.
BUCKET_BYTES = 16_000_000
#: A key with more rows than this is salted over the buckets.
HOT_ROWS = 1_000
OVERHEAD = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def scattered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """First pass: every row as ``record`` (a struct of all input columns) with its ``bucket``, and the number of buckets.

    Input columns stay inside ``record``, so their names cannot clash. Null ids and null texts are values like any other.
    Rows alike in id, size and checksum form one key; a key with over ``HOT_ROWS`` rows is salted by row position, so no
    bucket grows with the copies of a row. The order depends on the seed and the rows, for hot keys also on the files.
    """
    key = [F.col(id_col).alias("_id"), record_size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("crc")]
    keys = docs.select(*key).groupBy("_id", "size", "crc").count()
    total = keys.agg(F.sum(F.col("size") * F.col("count")).alias("b"), F.max("count").alias("n")).first()
    buckets = max(1, math.ceil((total.b or 0) / bucket_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), *key)
    if (total.n or 0) > HOT_ROWS:
        hot = keys.where(F.col("count") > HOT_ROWS).select(F.col("_id").alias("_i"), F.col("size").alias("_s"), F.col("crc").alias("_c"))
        is_hot = rows["_id"].eqNullSafe(hot["_i"]) & (rows["size"] == hot["_s"]) & (rows["crc"] == hot["_c"])
        rows = (rows.withColumn("_at", F.monotonically_increasing_id()).join(hot, is_hot, "left")
                .withColumn("_salt", F.when(F.col("_c").isNotNull(), F.col("_at")).otherwise(0)).drop("_i", "_s", "_c", "_at"))
    else:
        rows = rows.withColumn("_salt", F.lit(0).cast("long"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id").cast("string"), "size", "crc", "_salt"))
    return rows.withColumn("bucket", F.pmod("_h", F.lit(buckets)).cast("int")).drop("_id"), buckets


def fisher_yates(rows: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Second pass: ``record``, ``size``, ``crc``, ``bucket`` and ``place``, a shuffled order within the bucket.

    One partition is one bucket, in hash order before the shuffle, so a task that runs again gives the same order.
    """
    gathered = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("_h", "size", "crc", "_salt", "record"))).alias("_rows"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle("_rows", seed)).alias("place", "_row"))
    return mixed.select("_row.record", "_row.size", "_row.crc", "bucket", "place")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """``record``, ``size``, ``crc``, ``shard``, ``slot``: row counts of the shards differ by one at most, slots are gapless from 0."""
    rows, buckets = scattered(docs, seed=seed, **options)
    counts = rows.groupBy("bucket").count()
    offsets = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("_before"))
    position = F.col("_before") + F.col("place")
    return fisher_yates(rows, buckets, seed).join(offsets, "bucket").select(
        "record", "size", "crc", (position % shards).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write the records to ``path/shard=N``, in slot order within every file."""
    assigned.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").select(
        "shard", "slot", "record.*").write.partitionBy("shard").parquet(path)
