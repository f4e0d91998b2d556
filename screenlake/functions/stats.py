"""Statistics of screening runs as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_factorial(n: Column) -> Column:
    """Of a whole number: exact up to 20, Stirling's series beyond."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _at_most(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of a binomial with a mean of k or more.

    The term of k is taken through its logarithm, so it doesn't underflow, and the
    terms below come from it. They fall, and beyond five roots of n they sum to
    less than exp(-50), so their number grows with the root of n.
    """
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p))
    many = F.least(k, (5 * F.sqrt(n.cast("double")) + 50).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc, i):
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] * (k - i + 1) / (n - k + i) * (1 - p) / p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return top * F.aggregate(F.sequence(F.lit(0).cast("long"), many), start, step, lambda acc: acc["total"])


def _upper(k: Column, n: Column, tail: float, rounds: int = 60) -> Column:
    """The chance under which k or fewer of n have a probability of tail."""
    start = F.struct((k / n).alias("low"), F.lit(1.0).alias("high"))

    def step(acc, _):
        mid = (acc["low"] + acc["high"]) / 2
        half = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
        return F.when(_at_most(k, n, mid) > tail, half(mid, acc["high"])).otherwise(half(acc["low"], mid))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: (acc["low"] + acc["high"]) / 2)


def clopper_pearson(successes: Column, trials: Column, alpha: float = 0.05) -> Column:
    """Struct of low and high: the exact interval of a share; 0 and 1 without trials. Any number of trials will do."""
    k, n = successes.cast("long"), trials.cast("long")
    low = F.when((n == 0) | (k == 0), 0.0).otherwise(1 - _upper(n - k, n, alpha / 2))
    high = F.when((n == 0) | (k == n), 1.0).otherwise(_upper(k, n, alpha / 2))
    return F.struct(low.alias("low"), high.alias("high"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
