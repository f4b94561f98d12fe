"""Group-wise building blocks that never put one whole group into one task.

* ``attach_facts`` joins per-key facts onto many rows and salts only the keys
  that hold more than ``hot_rows`` rows.
* ``running`` gives ordered running aggregates in two levels: totals per
  bucket of the order axis, then a short window over the buckets, then a window
  inside each bucket.
* ``ordered_ids`` numbers rows 0..n-1 in a global order without one global sort.
* ``first_wins`` keeps one row per key with a map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leaktrail.session import maybe_broadcast, staged

HOT_ROWS = 1_000_000
SALTS = 256


def attach_facts(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, weight: str,
                 how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Join ``facts`` (one row per key; ``weight`` = rows of that key) onto ``rows``.

    At most ``total rows / hot_rows`` keys can be hot; their list is broadcast if its
    measured size allows. A hot key's rows spread over ``salts`` tasks and its
    single fact row is repeated once per salt. All other keys join as they are.
    The facts are written once: the list and every use of the join would compute them anew.
    """
    facts = staged(facts, "facts")
    is_hot = F.col(weight) > hot_rows
    hot = facts.filter(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salted = (rows.join(maybe_broadcast(hot), keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
              .drop("_hot"))
    spread_facts = facts.withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread_facts.drop(weight), [*keys, "_salt"], how).drop("_salt")


def salted_join(rows: DataFrame, dim: DataFrame, keys: list[str], spread: Column, salts: int = 32) -> DataFrame:
    """Inner join of many rows with a narrow dimension too large to broadcast.

    Every key's rows spread over ``salts`` tasks and the dimension is repeated as often,
    so a key that a third of all rows share costs 1/(3 x salts) of them per task; AQE
    can split further.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def _aggregate(kind: str, c: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c)


def running(df: DataFrame, keys: list[str], order: str, bucket: Column, wanted: dict[str, tuple[str, Column]],
            inclusive: bool = True, runs: dict[str, tuple] | None = None) -> DataFrame:
    """Running ``sum``/``min``/``max``/``last`` per key along ``order``, and lengths of consecutive runs.

    ``bucket`` must be non-decreasing in ``order``; a bucket holds as many rows of a
    key as one task should hold. Rows are summarised per (key, bucket), the summaries
    (one row per bucket) are scanned in order, and the carried values are joined back.
    ``inclusive=False`` leaves the current row out of the aggregates.

    ``runs`` maps a name to (condition, group, start, before): the number of rows up to
    here for which the condition has held without a break (0 where it does not hold); a
    change of ``group`` (may be None) restarts the count. ``start`` and ``before`` are the
    length and group carried in from earlier data (or None).
    """
    runs = runs or {}
    local = W.partitionBy(*keys, "_bucket").orderBy(order)
    base = df.withColumn("_bucket", bucket)
    for n, (_, expr) in wanted.items():
        base = base.withColumn(f"_in_{n}", expr)
    aggs = [_aggregate(kind, F.col(f"_in_{n}"), F.col(order)).alias(f"_tot_{n}") for n, (kind, _) in wanted.items()]
    if runs:
        base = base.withColumn("_ln", F.row_number().over(local))
        aggs.append(F.count(F.lit(1)).alias("_n"))
    for n, (cond, group, start, before_group) in runs.items():
        base = base.withColumn(f"_on_{n}", F.coalesce(cond, F.lit(False)))
        brk = F.when(~F.col(f"_on_{n}"), F.col("_ln"))
        if group:
            brk = brk.when(F.lag(group).over(local) != F.col(group), F.col("_ln") - 1)
            aggs += [F.min_by(group, order).alias(f"_fg_{n}"), F.max_by(group, order).alias(f"_lg_{n}")]
        base = base.withColumn(f"_brk_{n}", brk)
        aggs += [F.max(f"_brk_{n}").alias(f"_lb_{n}"),
                 F.max(start if start is not None else F.lit(0)).alias(f"_st_{n}"),
                 F.max(before_group if before_group is not None else F.lit(None).cast("string")).alias(f"_bg_{n}")]
    totals = base.groupBy(*keys, "_bucket").agg(*aggs)
    along = W.partitionBy(*keys).orderBy("_bucket")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)

    def over(kind, c, w):
        if kind == "last":
            return F.last(c, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c).over(w)

    carried = totals.withColumns({f"_pre_{n}": over(k, F.col(f"_tot_{n}"), earlier) for n, (k, _) in wanted.items()})
    if runs:
        carried = carried.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    for n, (_, group, _, _) in runs.items():
        changed = F.lit(False)
        if group:
            last_group = F.coalesce(F.lag(f"_lg_{n}").over(along), F.col(f"_bg_{n}"))
            changed = F.coalesce(last_group != F.col(f"_fg_{n}"), F.lit(False))
        carried = carried.withColumn(f"_ch_{n}", F.when(changed, F.col("_off")))
        carried = carried.withColumn(f"_gb_{n}", F.greatest(F.col("_off") + F.col(f"_lb_{n}"), F.col(f"_ch_{n}")))
        carried = carried.withColumn(f"_en_{n}", F.greatest(F.max(f"_gb_{n}").over(earlier), F.col(f"_ch_{n}")))
    keep = [f"_pre_{n}" for n in wanted] + (["_off"] if runs else []) + [f"_{x}_{n}" for n in runs for x in ("en", "st")]
    out = base.join(carried.select(*keys, "_bucket", *keep), [*keys, "_bucket"])
    inside = local.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    for n, (kind, _) in wanted.items():
        out = out.withColumn(n, _COMBINE[kind](F.col(f"_pre_{n}"), over(kind, F.col(f"_in_{n}"), inside)))
    for n in runs:
        here = F.col("_off") + F.max(f"_brk_{n}").over(local.rowsBetween(W.unboundedPreceding, 0))
        since = F.coalesce(F.greatest(F.col(f"_en_{n}"), here), -F.coalesce(f"_st_{n}", F.lit(0)))
        out = out.withColumn(n, F.when(F.col(f"_on_{n}"), F.col("_off") + F.col("_ln") - since).otherwise(0).cast("bigint"))
    return out.drop("_bucket", "_ln", *keep, *[f"_in_{n}" for n in wanted], *[f"_{x}_{n}" for n in runs for x in ("on", "brk")])


def previous(df: DataFrame, keys: list[str], order: str, bucket: Column, columns: dict[str, str]) -> DataFrame:
    """Value of the preceding row per key (a ``lag`` that crosses buckets)."""
    return running(df, keys, order, bucket, {new: ("last", F.col(old)) for new, old in columns.items()}, inclusive=False)


def ordered_ids(df: DataFrame, order: list[str], bucket: Column, name: str = "id") -> DataFrame:
    """Dense 0-based position in a global order.

    ``bucket`` is a prefix of the order (for hash order: its leading digits), so
    counts per bucket give the offsets and only one bucket is sorted per task.
    """
    base = df.withColumn("_bucket", bucket)
    counts = base.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_bucket").orderBy(*order)
    return (base.join(offsets, "_bucket")
            .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1).drop("_bucket", "_off"))


def first_in_order(df: DataFrame, order: list[str], bucket: Column, quota: DataFrame | int, keys: list[str] | None = None) -> DataFrame:
    """The first rows of an order, per key if given, exactly as many as the quota says.

    ``quota`` is a number or a frame (keys, ``quota``). Counts per (key, bucket) give
    offsets; a bucket that starts beyond the quota cannot contribute, so only the few
    buckets before the cut are shuffled and sorted.
    """
    keys = keys or []
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets = offsets.withColumn("quota", F.lit(quota)) if isinstance(quota, int) else offsets.join(quota.select(*keys, "quota"), keys)
    useful = maybe_broadcast(offsets.filter(F.col("_off") < F.col("quota")))
    rank = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return (rows.join(useful, [*keys, "_bucket"]).withColumn("_rank", F.col("_off") + rank)
            .filter(F.col("_rank") <= F.col("quota")).drop("_bucket", "_off", "_rank", "quota"))


def first_wins(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``; combines before the shuffle."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
