"""Redaction: ordered rewrite rules, known secrets, and checks before a log is shared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail import vocab as v

_SEP = r"(?:\\{2,4}|/)"

#: fixed values: (name, Java pattern, replacement); the order matters
RULES = [
    ("user_home", r"/Users/[A-Za-z0-9_]*/?", "/home/user/"),
    ("windows_user_path", rf"({_SEP}Users{_SEP})Administrator", "$1user"),
    ("collapsed_user_path", r"C:Users(?:Administrator|user)", "<HOME>"),
    ("ls_owner", r"Administrator(\s+)197121", "user$1user"),
    ("stat_owner", r"(\((?:19710[0-9]|19711[0-9]|19712[0-9])/)Administrator", "$1user"),
    ("account_number", r"\b(?:197108|197121)\b", "0"),
    ("username_variable", r"(USERNAME=)Administrator", "$1user"),
    ("computer_name", r"(COMPUTERNAME=)[A-Z0-9_-]+", "$1HOST"),
    ("logon_server", r"(LOGONSERVER=\\{2,4})[A-Z0-9_-]+", "$1HOST"),
    ("judge_base_field", r"(\"judge_api_base\"\s*:\s*\")https?://[^\"]+(\")", "$1<internal-gateway>$2"),
]

#: fixed values: texts and anchored patterns that must not remain
RESIDUES = {
    "home_path": r"/Users/", "account_number": r"197121", "username_variable": r"USERNAME=Administrator",
    "windows_user_path": rf"{_SEP}Users{_SEP}Administrator", "collapsed_user_path": r"C:UsersAdministrator",
    "ls_owner": r"Administrator\s+197121",
}


def _quote(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def project_rules(project: str | None = None, users: list[str] | None = None, host_name: str | None = None) -> list[tuple]:
    """Rules that need a site's own names; they run before the general ones."""
    out = []
    if project:
        out.append(("project_root", rf"/Users/[A-Za-z0-9_]+/[A-Za-z0-9_]*/{_quote(project)}/", f"/{project.lower()}/"))
    for user in sorted(users or [], key=len, reverse=True):
        out.append((f"user_{user}", _quote(user), "user"))
    if host_name:
        out.append(("host_name", _quote(host_name), "HOST"))
    return out


def variable_rules(urls: list[str] | None = None, paths: list[str] | None = None) -> list[tuple]:
    """Rules for named variables in dumped environments: those whose value is a private URL, and those that hold a local path.

    Other variables keep their values.
    """
    return ([(f"url_{n}", rf"(\b{_quote(n)}=)https?://[^\s\"'`,)]+", "$1<internal-gateway>") for n in urls or []]
            + [(f"path_{n}", rf"(\b{_quote(n)}=)[^\s\"'`,)]+", "$1<HOME>") for n in paths or []])


def folder_rules(folders: dict[str, str] | None = None) -> list[tuple]:
    """Rules that rename the folders of a site's tools, the longest first."""
    return [(f"folder_{k}", _quote(name), target) for k, (name, target) in
            enumerate(sorted((folders or {}).items(), key=lambda x: (-len(x[0]), x[0])))]


def host_rules(host: str | None) -> list[tuple]:
    """Rules that only run when a private host is configured."""
    if not host or not host.strip():
        return []
    h = _quote(host.strip())
    return [("api_base_field", rf'("(?:api_base|base_url)"\s*:\s*")https?://{h}[^"]*(")', "$1<internal-gateway>$2"),
            ("host_url", rf"https?://{h}[^\s\"'`,)]*", "<internal-gateway>"),
            ("bare_host", h, "internal-gateway")]


def apply_rules(c, rules: list[tuple] | None = None) -> Column:
    """All rules in order, as one chain of built-in replacements."""
    col = F.col(c) if isinstance(c, str) else c
    return reduce(lambda acc, r: F.regexp_replace(acc, r[1], r[2]), rules if rules is not None else RULES, col)


def rule_counts(df: DataFrame, text: str, rules: list[tuple] | None = None) -> DataFrame:
    """Matches of each rule in the raw texts, zero included; rules without a hit stay visible."""
    use = rules if rules is not None else RULES
    wide = df.agg(*[F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(r[1]))), F.lit(0)).cast("bigint").alias(r[0]) for r in use])
    return wide.unpivot([], [r[0] for r in use], "rule", "matches")


def clean(df: DataFrame, text: str, rules: list[tuple] | None = None) -> DataFrame:
    """``clean`` text and ``changed``, which looks at the result and not at any count."""
    return df.withColumn("clean", apply_rules(text, rules)).withColumn("changed", ~F.col("clean").eqNullSafe(F.col(text)))


def residues(c, extra: dict[str, str] | None = None, host: str | None = None) -> Column:
    """Names of sensitive patterns still present."""
    col = F.col(c) if isinstance(c, str) else c
    patterns = {**RESIDUES, **(extra or {})}
    if host:
        patterns["private_host"] = _quote(host)
    found = F.array(*[F.when(col.rlike(p), F.lit(n)) for n, p in patterns.items()])
    return F.filter(found, lambda x: x.isNotNull())


def release_violations(raw: DataFrame, cleaned: DataFrame, key: str, protected: list[str], text: str = "clean") -> DataFrame:
    """Rows that must not be shared: lost or added rows, changed protected fields, broken JSON, residues."""
    a = raw.select(key, *[F.col(c).alias(f"_a_{c}") for c in protected], F.lit(True).alias("_a"))
    b = cleaned.select(key, *[F.col(c).alias(f"_b_{c}") for c in protected], F.col(text).alias("_text"), F.lit(True).alias("_b"))
    j = a.join(b, key, "full")
    problems = F.concat(
        F.array(F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit("row_count")),
                F.when(F.col("_text").startswith("{") & F.try_parse_json("_text").isNull(), F.lit("not_json")),
                *[F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")),
                         F.lit(f"changed_{c}")) for c in protected]),
        F.transform(residues("_text"), lambda r: F.concat(F.lit("residue_"), r)))
    return j.select(key, F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def redact_known(text, values, cores) -> Column:
    """Replace known values, longest first, then known cores, with the marker. Literal replacement, no patterns."""
    col = F.col(text) if isinstance(text, str) else text

    def longest_first(a):
        return F.array_sort(F.array_distinct(a), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x))
                            .when(x < y, -1).when(x > y, 1).otherwise(0))

    def replace_all(start, items):
        return F.aggregate(longest_first(items), start, lambda acc, s: F.replace(acc, s, F.lit(v.REDACTED)))

    return replace_all(replace_all(col, values), cores)

