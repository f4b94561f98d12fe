"""Agreement of two raters over exactly the same items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaktrail.operators.quality import require_empty, set_difference


def joined(a: DataFrame, b: DataFrame, key: str = "task_id") -> DataFrame:
    """Labels side by side; differing item sets are fatal."""
    require_empty(set_difference(a, b, key), "raters cover different items")
    return a.select(key, F.col("label").alias("a")).join(b.select(key, F.col("label").alias("b")), key)


def confusion(a: DataFrame, b: DataFrame, key: str = "task_id") -> DataFrame:
    """tt, ta (only a true), tb (only b true), ff."""
    x, y = F.col("a"), F.col("b")
    return joined(a, b, key).agg(F.count_if(x & y).alias("tt"), F.count_if(x & ~y).alias("ta"), F.count_if(~x & y).alias("tb"),
                                 F.count_if(~x & ~y).alias("ff"))


def disagreements(a: DataFrame, b: DataFrame, key: str = "task_id") -> DataFrame:
    return joined(a, b, key).filter("a <> b")
