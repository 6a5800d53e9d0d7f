"""Classical tests from group aggregates, with p-values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quadrat.functions.ranking import average_ranks
from quadrat.functions.scratch import written


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    out = d
    for k in range(1, 2000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def p_value(kind: str, *columns: Column) -> Column:
    """p of a statistic and its degrees of freedom; for the few rows of a result."""
    of = {"t": t_two_sided, "f": f_upper, "chi2": chi2_upper}[kind]

    @F.pandas_udf(DoubleType())
    def p(*parts):
        values = [float("nan") if any(v is None or v != v for v in row) else of(*row) for row in zip(*parts, strict=True)]
        return parts[0].__class__(np.array(values, float))

    return p(*columns)


def welch(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: t and df of the two-sample test with unequal variances; NULL values are left out."""
    x = df.where(F.col(value).isNotNull())
    of = lambda g: [f(F.when(F.col(group) == F.lit(g), F.col(value))) for f in (F.count, F.avg, F.var_samp)]
    (n1, m1, v1), (n2, m2, v2) = of(first), of(second)
    s = x.agg(n1.alias("n1"), m1.alias("m1"), v1.alias("v1"), n2.alias("n2"), m2.alias("m2"), v2.alias("v2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    dof = F.pow(e1 + e2, 2) / (F.pow(e1, 2) / (F.col("n1") - 1) + F.pow(e2, 2) / (F.col("n2") - 1))
    return s.select(t.alias("t"), dof.alias("df"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F and its degrees of freedom, from group sums."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    every = Window.partitionBy()  # over the groups' rows, not the table's
    g = g.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between")
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.coalesce("v", F.lit(0.0)) * (F.col("n") - 1)).alias("within"), between)
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("N") - F.col("k")))
    return s.select(f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("N") - F.col("k")).alias("df2"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: the tie-corrected H statistic and its degrees of freedom."""
    # counts by value and group and the ranks of values are read several times: written once
    x = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(value, group)
    tied = written(x.groupBy(value, group).agg(F.count("*").alias("c")))
    ranks = written(average_ranks(tied, value, "c"))
    # one row for each value and group: a value that very many rows share meets its rank once a group
    g = tied.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    ties = ranks.agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("N").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return s.join(F.broadcast(ties)).select(h.alias("h"), (F.col("k") - 1).alias("df"))
