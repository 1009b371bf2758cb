"""Student's t for integer degrees of freedom: finite series, no special functions."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, functions as F


def _inside(t: float, df: int) -> float:
    """P(|T| < |t|) with the sign of t."""
    theta = math.atan(t / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    if df % 2:
        term = total = math.cos(theta) if df > 1 else 0.0
        for j in range(1, (df - 1) // 2):
            term *= c2 * 2 * j / (2 * j + 1)
            total += term
        return 2.0 / math.pi * (theta + math.sin(theta) * total)
    term = total = 1.0
    for j in range(1, df // 2):
        term *= c2 * (2 * j - 1) / (2 * j)
        total += term
    return math.sin(theta) * total


@lru_cache(maxsize=None)
def t_quantile_value(p: float, df: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 0.5 + _inside(mid, df) / 2.0 < p else (lo, mid)
    return (lo + hi) / 2.0


def t_tail(t: Column, df: Column) -> Column:
    """P(T > t) for an integer column of degrees of freedom."""
    theta = F.atan(t / F.sqrt(df.cast("double")))
    c, s = F.cos(theta), F.sin(theta)
    odd = df % 2 == 1
    first = F.when(~odd, F.lit(1.0)).when(df > 1, c).otherwise(F.lit(0.0))
    last = F.when(odd, (df - 1) / 2 - 1).otherwise(df / 2 - 1).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    factor = lambda j: F.when(odd, 2.0 * j / (2 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc, j):
        term = acc["term"] * c * c * factor(j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(steps, start, add)["total"]
    inside = F.when(odd, F.lit(2.0 / math.pi) * (theta + s * total)).otherwise(s * total)
    return (F.lit(1.0) - inside) / 2.0


def t_quantile(p: float, df: Column) -> Column:
    """Quantile for an integer column of degrees of freedom, however many, by bisection on ``t_tail``.

    The search runs over the angle ``atan(t / sqrt(df))``, which is bounded for every quantile.
    """
    root = F.sqrt(df.cast("double"))
    start = F.struct(F.lit(-math.pi / 2).alias("lo"), F.lit(math.pi / 2).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2.0
        below = t_tail(root * F.tan(mid), df) > F.lit(1.0 - p)
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve)
    return root * F.tan((found["lo"] + found["hi"]) / 2.0)
