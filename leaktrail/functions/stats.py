"""Intervals and tests as column expressions over counts, so they run on already aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaktrail import vocab as v


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


def rate(k, n, empty: float | None = 0.0) -> Column:
    """k / n; ``empty`` for an empty cell."""
    return F.when(_c(n) > 0, _d(k) / _d(n)).otherwise(F.lit(empty).cast("double"))


def wilson(k, n, z: float = v.Z95, empty: tuple[float, float] = (0.0, 1.0), clamp: bool = True, scale: float = 1.0):
    """(lo, hi) columns of the Wilson score interval."""
    kk, nn = _d(k), _d(n)
    p = kk / nn
    denom = 1.0 + z * z / nn
    center = p + z * z / (2.0 * nn)
    half = F.sqrt(p * (1.0 - p) / nn + z * z / (4.0 * nn * nn)) * z
    lo, hi = (center - half) / denom, (center + half) / denom
    if clamp:
        lo, hi = F.greatest(F.lit(0.0), lo), F.least(F.lit(1.0), hi)
    none = _c(n) <= 0
    return (F.when(none, F.lit(empty[0])).otherwise(lo * scale), F.when(none, F.lit(empty[1])).otherwise(hi * scale))


def wilson_text(k, n) -> Column:
    lo, hi = wilson(k, n, v.Z95_SHORT)
    return F.when(_c(n) > 0, F.format_string("[%.1f, %.1f]", lo * 100.0, hi * 100.0)).otherwise("[n/a]")


def wald_paired(n, b, c, z: float = v.Z95):
    nn, diff = _d(n), _d(b) - _d(c)
    se = F.sqrt(F.greatest(F.lit(0.0), (_d(b) + _d(c) - diff * diff / nn) / (nn * nn)))
    zero = _c(n) == 0
    return (F.when(zero, 0.0).otherwise(diff / nn - se * z), F.when(zero, 0.0).otherwise(diff / nn + se * z))


def normal_quantile(p) -> Column:
    """Rational approximation 26.2.23 of Abramowitz and Stegun."""
    q = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), _d(p)))
    tail = F.least(q, 1.0 - q)
    t = F.sqrt(F.log(tail) * -2.0)
    upper = t - (2.515517 + t * 0.802853 + t * t * 0.010328) / (1.0 + t * 1.432788 + t * t * 0.189269 + t * t * t * 0.001308)
    return F.when(q < 0.5, -upper).otherwise(upper)


def normal_cdf(x) -> Column:
    """Normal CDF from the continued series of erf (|x| < 3) and the asymptotic continued fraction of erfc."""
    z = _d(x)
    a = F.abs(z)
    # Series: phi(a) * (a + a^3/3 + a^5/15 + ...)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("s")),
                         lambda acc, k: F.struct((acc["t"] * a * a / (k * 2 + 1)).alias("t"),
                                                 (acc["s"] + acc["t"] * a * a / (k * 2 + 1)).alias("s")))["s"]
    phi = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda acc, k: k / (a + acc))
    tail = F.when(a < 3.0, 0.5 - phi * series).otherwise(phi / (a + fraction))
    return F.when(z < 0, tail).otherwise(1.0 - tail)


def log_factorial(n) -> Column:
    """ln n!: exact below 21, Stirling's series above (error below 1e-15)."""
    x = _d(n)
    stirling = (x * F.log(x) - x + F.log(x * (2 * math.pi)) * 0.5 + 1.0 / (x * 12.0) - 1.0 / (x * x * x * 360.0)
                + 1.0 / (x * x * x * x * x * 1260.0))
    return F.when(_c(n) <= 20, F.log(F.factorial(_c(n).cast("int")).cast("double"))).otherwise(stirling)


def log_choose(n, k) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(_c(n) - _c(k))


def _span(center, spread, low, high) -> Column:
    """Integers around a mode that carry all of the double-precision mass."""
    first = F.greatest(low, F.floor(center - spread).cast("bigint"))
    last = F.least(high, F.ceil(center + spread).cast("bigint"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


def mcnemar_exact(b, c) -> Column:
    """Exact two-sided p of the sign test on the discordant pairs."""
    m, k = _c(b) + _c(c), F.least(_c(b), _c(c))
    width = F.sqrt(_d(m)) * 10.0 + 100.0
    tail = _total(_span(_d(k), width, F.lit(0).cast("bigint"), k.cast("bigint")),
                  lambda i: F.exp(log_choose(m, i) - _d(m) * math.log(2.0)))
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), tail * 2.0))


def _log_hyper(x, row, col, n) -> Column:
    """ln P(X = x), X = overlap of a random ``row``-subset with a ``col``-subset of n."""
    return log_choose(col, x) + log_choose(_c(n) - _c(col), _c(row) - _c(x)) - log_choose(n, row)


def _hyper_span(row, col, n) -> Column:
    mean = _d(row) * _d(col) / _d(n)
    spread = F.sqrt(mean + 1.0) * 40.0 + 100.0
    low = F.greatest(F.lit(0).cast("bigint"), (_c(row) + _c(col) - _c(n)).cast("bigint"))
    return _span(mean, spread, low, F.least(_c(row), _c(col)).cast("bigint"))


def fisher_exact(a, b, c, d) -> Column:
    """Two-sided Fisher p: total probability of tables no likelier than the observed one."""
    a, b, c, d = (_c(x).cast("bigint") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    limit = _log_hyper(a, row, col, n) + math.log1p(1e-7)
    p = _total(_hyper_span(row, col, n), lambda x: F.when(_log_hyper(x, row, col, n) <= limit,
                                                          F.exp(_log_hyper(x, row, col, n))).otherwise(0.0))
    return F.when((row == 0) | (c + d == 0) | (col == 0) | (b + d == 0), 1.0).otherwise(F.least(F.lit(1.0), p))


def stars(p) -> Column:
    return F.when(_c(p) < 0.001, "***").when(_c(p) < 0.01, "**").when(_c(p) < 0.05, "*").otherwise("")


def permutation_p(ka, na, kb, nb) -> Column:
    """Two-sided permutation test of two 0/1 means, in the limit of all permutations."""
    ka, na, kb, nb = (_c(x).cast("bigint") for x in (ka, na, kb, nb))
    k, n = ka + kb, na + nb
    seen = F.abs(_d(ka) / na - _d(kb) / nb)
    p = _total(_hyper_span(na, k, n), lambda x: F.when(
        F.abs(_d(x) / na - _d(k - x) / nb) >= seen - 1e-12, F.exp(_log_hyper(x, na, k, n))).otherwise(0.0))
    return F.when((na == 0) | (nb == 0), 1.0).otherwise(F.least(F.lit(1.0), p))


def tango(n, b, c, z: float = v.Z95, steps: int = 60):
    """Score interval of Tango (1998) for a paired difference; both boundaries are tested first."""
    nn, bb, cc = _d(n), _d(b), _d(c)

    def score(t):
        lin = -bb - cc + (nn * 2.0 - bb + cc) * t
        const = -cc * t * (1.0 - t)
        p21 = (F.sqrt(F.greatest(F.lit(0.0), lin * lin - nn * 8.0 * const)) - lin) / (nn * 4.0)
        var = nn * (p21 * 2.0 + t * (1.0 - t))
        num = bb - cc - nn * t
        return F.when(var > 0.0, num / F.sqrt(var)).when(num == 0.0, 0.0).otherwise(F.signum(num) * float("inf"))

    def root(lo, hi, shift):
        # score falls in t: keep the half where it changes sign
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), F.struct(lo.alias("lo"), hi.alias("hi")),
            lambda s, _: F.when(score((s["lo"] + s["hi"]) / 2.0) + shift > 0.0,
                                F.struct(((s["lo"] + s["hi"]) / 2.0).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2.0).alias("hi"))))
        return (found["lo"] + found["hi"]) / 2.0

    point, edge = (bb - cc) / nn, 1.0 - 1e-9
    zero = _c(n) == 0
    lower = F.when(score(F.lit(-1.0)) - z <= 0.0, -1.0).otherwise(root(F.lit(-edge), point, -z))
    upper = F.when(score(F.lit(1.0)) + z >= 0.0, 1.0).otherwise(root(point, F.lit(edge), z))
    return F.when(zero, 0.0).otherwise(lower), F.when(zero, 0.0).otherwise(upper)


def hypergeometric_interval(k, n, pool, alpha: float = 0.05, steps: int = 40):
    """Exact finite-population interval of K / pool after k hits in n draws.

    Both tail probabilities are monotone in K, so each bound is found by integer
    bisection instead of trying every K.
    """
    k, n, pool = (_c(x).cast("bigint") for x in (k, n, pool))
    n = F.least(n, pool)
    k = F.greatest(F.lit(0).cast("bigint"), F.least(k, n))

    def mass(big_k, keep):
        low = F.greatest(F.lit(0).cast("bigint"), n + big_k - pool)
        high = F.least(n, big_k)
        mean = _d(n) * _d(big_k) / _d(pool)
        values = _span(mean, F.sqrt(mean + 1.0) * 40.0 + 100.0, low, high)
        return _total(values, lambda x: F.when(keep(x), F.exp(_log_hyper(x, n, big_k, pool))).otherwise(0.0))

    def bisect(go_right):
        """Smallest K in [0, pool] where go_right(K) is false."""
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).cast("bigint").alias("lo"), pool.alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
                go_right(F.floor((s["lo"] + s["hi"]) / 2).cast("bigint")),
                F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("bigint") + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("bigint").alias("hi"))))["lo"]

    low_k = bisect(lambda m: mass(m, lambda x: x >= k) <= alpha / 2.0)
    # largest K whose lower tail is above alpha/2 = one below the smallest K where it is not
    first_bad = bisect(lambda m: mass(m, lambda x: x <= k) > alpha / 2.0)
    at_pool = mass(pool, lambda x: x <= k) > alpha / 2.0
    high_k = F.when(at_pool, pool).otherwise(first_bad - 1)
    none = (n <= 0) | (pool <= 0)
    return (F.when(none, 0.0).otherwise(_d(low_k) / pool), F.when(none, 1.0).otherwise(_d(high_k) / pool))


def kappa(both_true, a_only, b_only, both_false) -> Column:
    """Cohen's kappa of a 2 x 2 table; 1 when chance agreement is total."""
    tt, ta, tb, ff = (_d(x) for x in (both_true, a_only, b_only, both_false))
    n = tt + ta + tb + ff
    pa, pb = (tt + ta) / n, (tt + tb) / n
    pe = pa * pb + (1.0 - pa) * (1.0 - pb)
    return F.when(n == 0, F.lit(None).cast("double")).when(pe == 1.0, 1.0).otherwise(((tt + ff) / n - pe) / (1.0 - pe))
