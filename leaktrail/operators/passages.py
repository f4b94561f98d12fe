"""Containment of long passages (several words) in long texts, exact at any dictionary size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail.operators.grouped import salted_join
from leaktrail.operators.matching import dictionary_pairs
from leaktrail.session import BROADCAST_ROWS, fits_broadcast


def _runs(words: int) -> str:
    return r"\S+(?:\s+\S+){" + str(words - 1) + "}"


def _hashes(text, pattern: str) -> Column:
    """Hash of every (overlapping) run of words; the look-ahead keeps the scan at one step per token."""
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def passage_pairs(texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str,
                  words: int = 8, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(text_id, passage_id) where the passage occurs in the text, character by character.

    The first and last token of a passage may be cut in the text, the inner ones are
    whole tokens there too. The smallest hash among the runs of inner tokens is the
    passage's anchor; a text that contains the passage contains that run, so an
    equality join on anchors finds every candidate and ``contains`` decides. The
    texts' runs stream through a broadcast of the anchors while those fit, and are
    shuffled as (anchor, id) pairs beyond. Passages with too few words have no
    anchor and go through the ten-character windows of ``matching.dictionary_pairs``.
    """
    p = passages.select(F.col(passage_id).alias("_pid"), F.col(passage).alias("_p"))
    # inner tokens: white space on both sides within the passage itself
    p = p.withColumn("_anchor", F.array_min(_hashes("_p", rf"(?<=\s)(?=({_runs(words)})\s)")))
    anchored, short = p.filter("_anchor IS NOT NULL"), p.filter("_anchor IS NULL")
    windows = F.explode(_hashes(text, rf"(?<!\S)(?=({_runs(words)})(?!\S))")).alias("_anchor")
    if fits_broadcast(p, max_rows):
        found = (texts.select(F.col(text_id), F.col(text).alias("_t"), windows).join(F.broadcast(anchored), "_anchor")
                 .filter(F.contains("_t", F.col("_p"))).select(text_id, "_pid"))
    else:
        candidates = salted_join(texts.select(text_id, windows), anchored.select("_anchor", "_pid"), ["_anchor"], F.col(text_id))
        rows = candidates.select(text_id, "_pid").distinct().join(texts.select(text_id, F.col(text).alias("_t")), text_id)
        found = (salted_join(rows, anchored.select("_pid", "_p"), ["_pid"], F.col(text_id))
                 .filter(F.contains("_t", F.col("_p"))).select(text_id, "_pid"))
    if not short.isEmpty():
        dictionary = short.select(F.lit(1).alias("_k"), F.col("_pid").alias("canary_id"), F.array("_p").alias("needles"))
        pairs = dictionary_pairs(texts.select(text_id, text, F.lit(1).alias("_k")), dictionary, F.col(text), "_k", max_rows, row_id=(text_id,))
        found = found.unionByName(pairs.select(text_id, F.col("canary_id").alias("_pid")))
    return found.distinct().withColumnRenamed("_pid", passage_id)
