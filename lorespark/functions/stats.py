"""Column functions for tests of chance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2).cast("bigint"), F.greatest(n, F.lit(2)).cast("bigint")), F.lit(0.0), lambda s, x: s + F.log(x.cast("double"))))


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def binomial_tail(n: Column, k: Column, q: Column) -> Column:
    """The chance of at least k of n, each with chance q; 1 for k = 0."""
    n, k = n.cast("bigint"), k.cast("bigint")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), q))
    # The terms follow from each other: C(n, i + 1) = C(n, i) * (n - i) / (i + 1).
    first = F.struct((ln_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)).alias("ln"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["ln"] + F.log((n - i + F.when(i == n, 1.0).otherwise(0.0)).cast("double") / (i + 1)) + F.log(p) - F.log(1 - p)).alias("ln"), (s["sum"] + F.exp(s["ln"])).alias("sum"))
    tail = F.aggregate(F.sequence(k, F.greatest(n, k)), first, step, lambda s: s["sum"])
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
