"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from leaktrail.llm import (byte_bpe, embedding_dedup, mixing, negatives, packing, periodic, quality, sharding, simhash, substring_dedup, suffix_dedup,
                           token_counts, toxicity)
from leaktrail.llm.registry import query, table


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                                                    counted.alias("n_tokens"))
    return docs.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op3_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode(F.col("text"), *ranks).alias("ids"))
    both = ids.select("doc_id", "ids", byte_bpe.decode(F.col("ids"), *ranks).alias("decoded"))
    return both.select("doc_id", byte_bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(table(spark, sf_dir, "documents"))
    return dealt.select("record.doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query("op5_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query("op4_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_substring_dedup", substring_dedup.SQL)
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_suffix_dedup")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", suffix_dedup.n_removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_embedding_dedup")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_source_mixing", mixing.SQL)
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("record.doc_id", "source", "pass", "block", F.round("weight", 9).alias("weight"))


@query("op11_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_hard_negatives")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, distinct_ids=False)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents the words from one on repeat those that follow it, a period long."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n = F.when(F.size("w") > 0, F.size("w"))
    g = F.floor(F.col("h") / 10)
    cut = words.select("*", n.alias("n"), (g % n).cast("int").alias("a"), g.alias("g"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    changed = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), rest))
    return cut.select("doc_id", F.when(F.col("n").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def periodic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planted(table(spark, sf_dir, "documents")).select("doc_id", periodic.find_runs("text").alias("f"))
    longest = F.array_max(F.transform("f.runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.transform("f.runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
                                                      F.lit("\n")))
    out = found.select("doc_id", F.size("f.runs").cast("long").alias("n_runs"), longest.alias("l"),
                       F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2(F.col("f.collapsed"), 256).alias("collapsed_sha256"))
    period = -F.col("l.p")
    return out.select("doc_id", "n_runs", (-F.col("l.s")).alias("start"), F.col("l.length").alias("length"), period.alias("period"),
                      F.expr("1000 * l.length div -l.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
