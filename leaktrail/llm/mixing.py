"""Mixing sources to target weights by temperature (operator 9, DataFrame functions only).

Token shares of the sources are raised to an exponent between 0 (equal weights) and 1 (the
natural shares) and normalised. Two bisections find the exponent: the largest that reaches
a target entropy, and the smallest that repeats no source beyond a limit; the larger of the
two is used, so the limit always holds. Weights become token budgets. A budget is whole
passes over a source and then a part of one more: the source's documents lie in hashed
blocks, the blocks in a seeded permutation, and blocks are taken until the budget is used,
the last one document by document. Only the block sums and one block per source are ever
ordered; what a source takes is told by one row, so the documents themselves never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaktrail.llm.staging import stage
from leaktrail.session import maybe_broadcast

SEED = 42
#: Entropy to reach, as a share of that of equal weights.
TARGET_ENTROPY = 0.95
#: No source is passed over more often than this.
MAX_REPEATS = 2.0
#: Documents that one block of a source's order should hold.
BLOCK_ROWS = 1_000
STEPS = 50


def token_length(text: Column) -> Column:
    """Words of ``text`` between ASCII white space; 0 for null."""
    plain = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\f\r":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def order_key(id_: Column, text: Column, seed: int) -> Column:
    """Place of a document in its block: a seeded digest, so equal rows stay together."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), blocks)


def block_key(source: Column, block: Column, seed: int) -> Column:
    """Place of a block in the permutation of its source's blocks."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")), F.lit(":"), block.cast("string")))


def _power_sums(shares: Column, alpha: Column) -> Column:
    """(z, q): sums of p^alpha and of p^alpha ln p."""
    return F.aggregate(shares, F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("q")), lambda acc, p: F.struct(
        (acc["z"] + F.pow(p, alpha)).alias("z"), (acc["q"] + F.pow(p, alpha) * F.log(p)).alias("q")))


def _entropy(shares: Column, alpha: Column) -> Column:
    sums = _power_sums(shares, alpha)
    return F.log(sums["z"]) - alpha * sums["q"] / sums["z"]


def _repeats(shares: Column, alpha: Column, budget: float | None) -> Column:
    """Most passes over a source. Without a budget the least used source has one pass."""
    if budget is None:
        return F.pow(F.array_max(shares) / F.array_min(shares), 1 - alpha)
    return budget * F.pow(F.array_min(shares), alpha - 1) / _power_sums(shares, alpha)["z"]


def _bisect(holds, keep_low: bool) -> Column:
    """Boundary between 0 and 1 of a monotone condition: the side on which it holds."""
    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        up = holds(mid) if keep_low else ~holds(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return ends["lo"] if keep_low else ends["hi"]


def weights(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """(source, rows, tokens, share, alpha, weight, budget): the mixture in tokens. ``totals`` has a row per source.

    Sources without tokens are left out. ``budget`` is the mixture's size as a share of the corpus; by default the
    smallest that passes over every source once. The row per source is gathered in one row to bisect over.
    """
    some = totals.where("tokens > 0")
    one = some.agg(F.sort_array(F.collect_list(F.struct("source", "rows", "tokens"))).alias("sources"), F.sum("tokens").alias("all"))
    one = one.withColumn("shares", F.transform("sources", lambda s: s["tokens"] / F.col("all").cast("double")))
    shares = F.col("shares")
    reached = lambda a: _entropy(shares, a) >= target_entropy * F.log(F.size(shares).cast("double"))
    allowed = lambda a: _repeats(shares, a, budget) <= max_repeats
    one_ = F.lit(1.0)
    one = one.withColumn("by_entropy", F.when(reached(one_), 1.0).otherwise(_bisect(reached, True)))
    one = one.withColumn("by_repeats", F.when(allowed(F.lit(0.0)), 0.0).otherwise(_bisect(allowed, False)))
    one = one.withColumn("alpha", F.greatest("by_entropy", "by_repeats")).withColumn("z", _power_sums(shares, F.col("alpha"))["z"])
    size = (F.col("all") * (F.col("z") * F.pow(F.array_max("shares"), 1 - F.col("alpha"))) if budget is None else F.col("all") * budget)
    rows = one.select("alpha", "z", "all", size.alias("size"), F.explode("sources").alias("s"))
    share = F.col("s.tokens") / F.col("all").cast("double")
    weight = F.pow(share, F.col("alpha")) / F.col("z")
    return rows.select("s.source", "s.rows", "s.tokens", share.alias("share"), "alpha", weight.alias("weight"),
                       F.round(weight * F.col("size")).cast("long").alias("budget"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
         block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """``weights`` with, per source, its ``blocks``, whole ``passes``, and where one more pass ends: ``cut_block``, ``cut_key``."""
    narrow, _ = stage(docs.select(F.col(source_col).cast("string").alias("source"), token_length(F.col(text_col)).alias("n"),
                                  order_key(F.col(id_col), F.col(text_col), seed).alias("key")), "mix-tokens")
    totals = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    budgets, _ = stage(weights(totals, **options).withColumn("blocks", F.ceil(F.col("rows") / F.lit(block_rows)).cast("long"))
                       .withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
                       .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens")), "mix-budgets")
    small = maybe_broadcast(budgets.select(F.col("source").alias("s"), "blocks", "rest"))
    placed = narrow.join(small, F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "key", "rest", block_of(F.col("key"), F.col("blocks")).alias("block"))
    sums = placed.groupBy("source", "rest", "block").agg(F.sum("n").alias("n")).withColumn("place", block_key(F.col("source"), F.col("block"), seed))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("place"))
    last = sums.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(
        F.min_by(F.struct("block", "place", (F.col("upto") - F.col("n")).alias("before")), "place").alias("cut")).select(
        F.col("source").alias("s"), "cut.*")
    last, _ = stage(last, "mix-cuts")
    cut = maybe_broadcast(last)
    inner = placed.join(cut.select("s", F.col("block").alias("b"), "before"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inner = inner.groupBy("source", "rest", "before", "key").agg(F.sum("n").alias("n"))
    within = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("key"))
    ends = inner.withColumn("upto", within).where("upto <= rest").groupBy("source").agg(F.max("key").alias("cut_key")).withColumnRenamed("source", "s")
    done = budgets.join(last.select("s", F.col("place").alias("cut_block")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return done.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """(record, source, pass, block, weight): the mixture, a row per document and pass; ``record`` holds every input column.

    A null source is a source of its own. Null texts count no tokens; a source without tokens has no weight and leaves.
    Equal rows share one place and are taken together. A pass that is not whole never exceeds its budget. Input columns
    stay inside ``record``, so their names cannot clash. An empty table gives no rows.
    """
    planned, _ = stage(plan(docs, id_col, text_col, source_col, seed, **options), "mix-plan")
    small = maybe_broadcast(planned.select(F.col("source").alias("s"), "weight", "blocks", "passes", "cut_block", "cut_key"))
    source = F.col(source_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), source.alias("source"),
                       order_key(F.col(id_col), F.col(text_col), seed).alias("key"))
    rows = rows.join(small, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block_of(F.col("key"), F.col("blocks")))
    place = block_key(F.col("source"), F.col("block"), seed)
    more = (place < F.col("cut_block")) | ((place == F.col("cut_block")) & (F.col("key") <= F.col("cut_key")))
    copies = F.col("passes").cast("int") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("copies", copies).where("copies > 0").select(
        "record", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"), F.col("block").alias("block"), "weight")


#: What ``mix`` gives for the documents table, said in SQL.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
t AS (SELECT source, count(*) AS n_rows, sum(n) AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
p AS (SELECT *, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM t) AS share FROM t),
alphas AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS rlo, CAST(1 AS DOUBLE) AS rhi
  UNION ALL
  SELECT step + 1, CASE WHEN h THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h THEN hi ELSE (lo + hi) / 2 END,
         CASE WHEN r THEN rlo ELSE (rlo + rhi) / 2 END, CASE WHEN r THEN (rlo + rhi) / 2 ELSE rhi END
  FROM (SELECT a.step, a.lo, a.hi, a.rlo, a.rhi,
          (SELECT ln(sum(pow(share, (a.lo + a.hi) / 2))) - (a.lo + a.hi) / 2 * sum(pow(share, (a.lo + a.hi) / 2) * ln(share)) / sum(pow(share, (a.lo + a.hi) / 2)) FROM p)
            >= {TARGET_ENTROPY} * (SELECT ln(count(*)) FROM p) AS h,
          (SELECT pow(max(share) / min(share), 1 - (a.rlo + a.rhi) / 2) FROM p) <= {MAX_REPEATS} AS r
        FROM alphas a WHERE a.step < {STEPS})),
alpha AS (
  SELECT greatest(CASE WHEN (SELECT -sum(share * ln(share)) >= {TARGET_ENTROPY} * ln(count(*)) FROM p) THEN 1 ELSE lo END,
                  CASE WHEN (SELECT max(share) / min(share) <= {MAX_REPEATS} FROM p) THEN 0 ELSE rhi END) AS a
  FROM alphas WHERE step = {STEPS}),
z AS (SELECT a, sum(pow(share, a)) AS z, max(pow(share, 1 - a)) AS top, sum(tokens) AS total FROM p, alpha GROUP BY a),
b AS (
  SELECT source, n_rows, tokens, pow(share, a) / z AS weight, CAST(round(pow(share, a) / z * (total * (z * top))) AS BIGINT) AS budget,
         CAST(ceil(n_rows / {BLOCK_ROWS}.0) AS BIGINT) AS blocks FROM p, z),
o AS (
  SELECT d.doc_id, d.source, d.n, d.key, b.weight, b.budget // b.tokens AS passes, b.budget % b.tokens AS rest,
         CAST('0x' || substr(d.key, 1, 15) AS BIGINT) % b.blocks AS block
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(source, '') || ':' || CAST(block AS VARCHAR)), key) AS upto FROM o),
c AS (SELECT *, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, source, CAST(unnest(range(CAST(copies AS BIGINT))) AS INTEGER) AS pass, block, round(weight, 9) AS weight FROM c
"""
