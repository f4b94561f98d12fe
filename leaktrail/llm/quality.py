"""Quality rules: base rules and a hashed n-gram likelihood ratio (operator 1, DataFrame functions only).

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted, one over the trusted target, one over every document; a document's
score is the mean of log p_target / p_raw over its n-grams, and it is kept if the score
reaches a fixed threshold. Both passes scan the documents without shuffling them: what
moves is at most one row per bucket and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams.
BUCKETS = 10_000
#: Lowest mean log-likelihood ratio of a kept document.
THRESHOLD = -0.08
#: Grams of the raw corpus that the target multinomial is smoothed with, per bucket; little evidence then says little.
PRIOR = 10
#: At most this many labelled rows (the first by hash) stand for the trusted target.
TARGET_ROWS = 20_000
MIN_WORDS = 50

BLANKS = "\t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words of ``text`` between ASCII white space (space, tab to carriage return); none for null."""
    plain = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def word_hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def grams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbours, from the words' hashes."""
    rest = F.greatest(F.size(hashes) - 1, F.lit(0))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pairs = F.zip_with(F.slice(hashes, 1, rest), F.slice(hashes, 2, rest), lambda a, b: bucket(F.xxhash64(a, b)))
    return F.concat(F.transform(hashes, bucket), pairs)


def trusted_rows(labels: DataFrame, limit: int = TARGET_ROWS) -> DataFrame:
    """Ids of at most ``limit`` rows labelled as good, the first by hash, so that the choice does not follow the ids.

    A null label is not trusted; an id labelled both ways counts as trusted; null ids are left out.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def ratio_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``ratios``, the log-likelihood ratio per bucket.

    The raw multinomial is add-one smoothed, the target's has ``PRIOR`` grams a bucket drawn from the raw one.

    ``trusted`` has at most ``TARGET_ROWS`` ids, so it is broadcast. Empty inputs give equal multinomials, ratios of 0.
    """
    flagged = docs.select(F.col(id_col).alias("_id"), word_hashes(words(F.col(text_col))).alias("_h")).join(
        F.broadcast(trusted.select(F.col(trusted.columns[0]).alias("_id"), F.lit(1).alias("_good"))), "_id", "left")
    counted = (flagged.select(F.coalesce("_good", F.lit(0)).alias("_good"), F.explode(grams(F.col("_h"), buckets)).alias("bucket"))
               .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").alias("target")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counted, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
                    (F.sum("raw") + buckets).alias("all_raw"), (F.sum("target") + PRIOR * buckets).alias("all_target"))
    raw = lambda r: (r["raw"] + 1) / F.col("all_raw")
    ratio = F.transform("rows", lambda r: F.log((r["target"] + PRIOR * buckets * raw(r)) / F.col("all_target")) - F.log(raw(r)))
    return rows.select(ratio.alias("ratios"))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``record`` of all input columns, ``_id``, ``_h`` word hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row of ``docs``.

    A null text counts as empty: no words, all counts 0. Repeated three-word windows are found by sorting the windows'
    64-bit hashes inside the row, so a very long text costs n log n and no row leaves its task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    step = docs.select(record, F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w"), lines.alias("_lines"),
                       (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"))
    step = step.select("record", "_id", "n_symbols", "_lines", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                       word_hashes(F.col("_w")).alias("_h"))
    h, w = F.col("_h"), F.col("_win")
    windows = F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda c, k: F.xxhash64(F.get(h, k), F.get(h, k + 1), c))
    step = step.withColumn("_win", windows)
    ordered = F.sort_array(F.transform(w, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
    step = step.withColumn("_s", F.when(F.size(F.array_distinct(w)) < F.size(w), ordered))
    s = F.col("_s")
    same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
    twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["k"], x["k"] + 1, x["k"] + 2)))))
    return step.select("record", "_id", "_h", F.size("_h").cast("long").alias("n_words"), "word_chars", "n_symbols",
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.when(s.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
          threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS, with_record: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, the base counts, ``base_failed``, ``kept``, ``score``; on request ``record`` too.

    ``record`` holds every input column, so names cannot clash. Repeated rows are judged alike; null ids keep their row; a
    text without n-grams scores 0 and fails the base rules; an empty table gives no rows. Rows leave through a generator:
    without it a filter on the verdict would be pushed below the projections and compute the words again in each use.
    """
    ratios = ratio_table(docs, trusted_rows(labels, target_rows), id_col, text_col, buckets)
    counted = base_counts(docs, id_col, text_col)
    counted = counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = counted.withColumn("_g", grams(F.col("_h"), buckets)).withColumn("_r", ratios.scalar())
    r = F.col("_r")
    total = F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + F.get(r, g))
    scored = counted.withColumn("score", F.when(F.size("_g") == 0, 0.0).otherwise(total / F.size("_g")))
    columns = [F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
               (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score"]
    return scored.select(F.inline(F.array(F.struct(*(["record"] if with_record else []), *columns))))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps."""
    return judge(docs, labels, with_record=True, **options).where("kept").select("record.*")
