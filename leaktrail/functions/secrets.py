"""Secret dictionary: core of a value, fragments, and the needles to search for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v

_SSN = r"^\d{3}-\d{2}-\d{4}$"


def _tail(value: Column, n: Column) -> Column:
    return F.substring(value, F.length(value) - n + 1, n)


def secret_core(value) -> Column:
    """The distinctive part of a secret, chosen by its format."""
    x = F.col(value) if isinstance(value, str) else value
    n = F.length(x)
    # First matching prefix decides, longest first; a short rest falls through to the other rules.
    after_prefix = F.lit(None).cast("string")
    for p in sorted(v.SECRET_PREFIXES, key=len):
        rest = F.substring(x, F.lit(len(p) + 1), n)
        after_prefix = F.when(F.startswith(x, F.lit(p)), F.when(F.length(rest) >= v.MIN_FRAGMENT, rest)).otherwise(after_prefix)
    bot_token = F.regexp_extract(x, r"(?s)^xox[br]-[^-]*-(.{10,})$", 1)
    host = F.split_part(F.regexp_extract(x, r"(?s)^[^@]*@(.*)$", 1), F.lit("."), F.lit(1))
    mail = F.concat(F.split_part(x, F.lit("@"), F.lit(1)), F.lit("@"), host)
    is_mail = F.regexp_extract(x, r"(?s)^[^@]*@(.*)$", 1).contains(".")
    last_part = F.element_at(F.split(x, "/"), -1)
    share = F.floor(n * F.lit(0.7)).cast("int")
    return (F.when(after_prefix.isNotNull(), after_prefix)
            .when(bot_token != "", bot_token)
            .when(x.rlike(_SSN), _tail(x, F.lit(10)))
            .when(is_mail & (mail != x) & (F.length(mail) >= v.MIN_FRAGMENT), mail)
            .when(x.contains("/") & (n > 30) & (F.length(last_part) >= v.MIN_FRAGMENT), last_part)
            .when(n >= 14, _tail(x, F.greatest(F.lit(10), share)))
            .when(n >= 8, _tail(x, F.greatest(F.lit(4), n - 3)))
            .when(n >= 5, F.substring(x, F.lit(2), n))
            .otherwise(x))


def secret_fragments(value, core) -> Column:
    """Parts of a secret, ten characters or longer, that betray it on their own."""
    x = F.col(value) if isinstance(value, str) else value
    c = F.col(core) if isinstance(core, str) else core
    nothing = F.array().cast("array<string>")
    runs = F.regexp_extract_all(x, F.lit("[a-zA-Z0-9]{10,}"), F.lit(0))
    ssn = F.when(x.rlike(_SSN), F.array(F.replace(x, F.lit("-"), F.lit("")))).otherwise(nothing)
    mail = F.when(x.contains("@"), F.array(F.split_part(x, F.lit("@"), F.lit(1)))).otherwise(nothing)
    parts = F.array_distinct(F.concat(F.array(c), runs, ssn, mail))
    return F.filter(parts, lambda p: F.length(p) >= v.MIN_FRAGMENT)


def build_dictionary(secrets: DataFrame, core: str | None = None) -> DataFrame:
    """``(env_type, canary_id, value)`` -> dictionary rows with core, fragments and needles.

    ``needles`` are the shortest strings that must be present whenever the value,
    the core or a fragment is: one pass over a text then rules out most secrets.
    """
    d = secrets.withColumn("core", F.col(core) if core else secret_core("value"))
    d = d.withColumn("fragments", secret_fragments("value", "core"))
    every = F.array_distinct(F.concat(F.array("value", "core"), F.col("fragments")))
    needles = F.filter(every, lambda a: ~F.exists(every, lambda b: (a != b) & F.contains(a, b)))
    return d.select("env_type", "canary_id", "value", "core", "fragments", needles.alias("needles"))
