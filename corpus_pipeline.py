"""Five stages that turn the documents table into encoded training data.

Every stage is one operator of ``leaktrail.llm`` over all rows its predecessor kept. A stage takes
(spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaktrail.llm import byte_bpe, mixing, quality, simhash, suffix_dedup
from leaktrail.llm.staging import discard, quoted, stage
from leaktrail.session import importable

#: Pre-tokens an encoding worker remembers; workers of earlier stages still hold memory then.
KEPT_WORDS = 250_000
#: Fingerprints, suffix arrays and token ids have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    importable(spark)
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes go from the texts, with characters they cut; a document left without text goes.

    Only a row number travels with the texts; the rows wait, written once, and get their new texts in a join.
    """
    importable(spark)
    rest = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    numbered, _ = stage(docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*rest).alias("record")), "numbered")
    left = suffix_dedup.remove_repeats(numbered, id_col="row", as_text=True).where(F.length("kept") > 0).select("row", "kept")
    size = F.length("kept").cast(docs.schema["n_chars"].dataType)
    made = {"text": F.col("kept"), "n_chars": size}
    return numbered.select("row", "record").join(left, "row").select(
        *[made.get(c, F.col("record").getField(c)).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document once, those of sources with more weight again within their budget."""
    return mixing.mix(docs).select("record.*")


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed, 32 bits), with digests of the ids and of what they decode to."""
    importable(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, KEPT_WORDS
    ids = docs.select("doc_id", "source", byte_bpe.encode(F.col("text"), *ranks).alias("ids"))
    both = ids.select("doc_id", "source", "ids", byte_bpe.decode(F.col("ids"), *ranks).alias("decoded"))
    return both.select("doc_id", "source", "ids", byte_bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read as the next one's input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs, path = stage(step(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(docs, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
