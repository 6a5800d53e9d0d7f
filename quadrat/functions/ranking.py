"""Ranks over a whole table without one task that holds it.

Values are cut into ranges at approximate quantiles; running sums within a range and the totals of
the ranges before it give exact ranks, whatever the cuts.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.scratch import written

RANGES = 64


def ranges(df: DataFrame, value: str, n: int = RANGES) -> Column:
    """The number of the range that a value falls in: an expression with n - 1 literals."""
    cuts = sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.002)))
    return reduce(operator.add, [(F.col(value) >= F.lit(float(c))).cast("int") for c in cuts], F.lit(0))


def running(df: DataFrame, value: str, sums: list[str], n: int = RANGES, by: list[str] | None = None) -> DataFrame:
    """Per distinct value (of each group): ``sums`` summed, and the sums over all smaller values as ``<name>_before``."""
    by = by or []
    per_value = df.withColumn("_range", ranges(df, value, n)).groupBy(*by, "_range", value).agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = per_value.select(*by, "_range", value, *sums, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in sums])
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows of a group
    offsets = per_value.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = offsets.select(*by, "_range", *[F.coalesce(F.sum(s).over(along), F.lit(0)).alias(f"o_{s}") for s in sums])
    # one row for each range; with groups, the planner decides by their number
    joined = inside.join(offsets if by else F.broadcast(offsets), [*by, "_range"])
    return joined.select(*by, value, *sums, *[(F.col(f"_{s}") + F.col(f"o_{s}")).alias(f"{s}_before") for s in sums])


#: Parts into which a pass of ``quantiles`` cuts what is left of a range.
PARTS = 1 << 12
#: Rows that one task may sort to end the search within a part.
SORTED = 200_000


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, of each group: an array ``q``, one entry for each of ``probs``.

    A row counts ``weight`` times; NULL and NaN do not count, and where nothing does there is no quantile. A
    pass counts values by part of the range in which wanted places lie (with map-side sums), and the next pass looks into the
    parts that hold them, until a part is one value, or until every part left has at most ``SORTED`` values: only these are shuffled and
    sorted, each part by itself. The ends of a range are parts of their own, so outliers cost a pass.
    """
    by = by or []
    v = F.col(value).cast("double")
    x = written(df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n")).where("_n > 0"))
    whole = written(x.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), (F.sum("_n") - 1).alias("_last")).where("_lo is not null"))
    sides = [f(F.col("_last") * F.lit(p)) for p in probs for f in (F.floor, F.ceil)]
    ranks = whole.select(*by, F.explode(F.array_distinct(F.array(*sides))).alias("_rank"))
    named = lambda d, tag: d.withColumnsRenamed({c: f"{c}{tag}" for c in by})
    same = lambda a, b: reduce(operator.and_, [a[c].eqNullSafe(b[f"{c}_r"]) for c in by], F.lit(True))
    parts, found = whole.select(*by, "_lo", "_hi", F.lit(0).cast("long").alias("_before")), None
    while True:
        p = named(parts, "_r")
        inside = x.join(F.broadcast(p) if not by else p, same(x, p) & (x["_v"] >= p["_lo"]) & (x["_v"] <= p["_hi"]))
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        at = F.least(F.lit(PARTS - 2), F.greatest(F.lit(1), F.floor(F.nanvl(share, F.lit(0.0)) * PARTS)))
        at = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), PARTS - 1).otherwise(at)
        counts = inside.groupBy(*by, "_lo", "_hi", "_before", at.alias("_at")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        run = Window.partitionBy(*by, "_lo", "_hi", "_before").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
        counts = counts.select(*by, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_n", "_rows", (F.col("_before") + F.coalesce(F.sum("_n").over(run), F.lit(0))).alias("_before"))
        r = named(ranks, "_r")
        held = counts.join(F.broadcast(r) if not by else r, same(counts, r) & (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        held = written(held.select(*by, "_rank", "_lo", "_hi", "_before", "_rows"))
        one = held.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_q"))
        found = one if found is None else found.union(one)
        left = held.where("_lo < _hi")
        most = left.agg(F.max("_rows")).first()[0]
        if most is None:
            break
        parts = left.select(*by, "_lo", "_hi", "_before").distinct()
        if most <= SORTED:
            p = named(parts, "_r")
            near = x.join(F.broadcast(p) if not by else p, same(x, p) & (x["_v"] >= p["_lo"]) & (x["_v"] <= p["_hi"]))
            values = near.groupBy(*by, "_before", "_v").agg(F.sum("_n").alias("_n"))
            upto = Window.partitionBy(*by, "_before").orderBy("_v")  # SORTED rows at most
            last = values.withColumn("_to", F.col("_before") + F.sum("_n").over(upto))
            r = named(left.select(*by, "_rank", F.col("_before").alias("_part")), "_r")
            hit = last.join(r, same(last, r) & (last["_before"] == r["_part"]) & (r["_rank"] < last["_to"]) & (r["_rank"] >= last["_to"] - last["_n"]))
            found = found.union(hit.select(*by, "_rank", F.col("_v").alias("_q")))
            break
    places = F.map_from_entries(F.collect_list(F.struct("_rank", "_q")))
    known = found.groupBy(*by).agg(places.alias("_m"))
    k = named(known, "_r")
    out = whole.join(k, same(whole, k)) if by else whole.join(F.broadcast(k))
    low, high = ([F.element_at("_m", f(F.col("_last") * F.lit(p))) for p in probs] for f in (F.floor, F.ceil))
    between = [a + (b - a) * (F.col("_last") * F.lit(p) - F.floor(F.col("_last") * F.lit(p))) for a, b, p in zip(low, high, probs, strict=True)]
    return out.select(*by, F.array(*[F.when(a == b, a).otherwise(c) for a, b, c in zip(low, high, between, strict=True)]).alias("q"))


def average_ranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """value, n (rows with it, each ``weight`` times), rank: the mean of the ranks that tied rows share, from 1."""
    r = running(df.withColumn("_n", F.col(weight) if weight else F.lit(1)), value, ["_n"])
    return r.select(value, F.col("_n").alias("n"), (F.col("_n_before") + (F.col("_n") + 1) / 2).alias("rank"))


def batch_numbers(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with ``batch``: rows in the order of a numeric key, ``size`` to a batch. Equal keys fall together."""
    r = running(df.withColumn("_n", F.lit(1)), key, ["_n"])
    return df.join(r.select(key, F.floor(F.col("_n_before") / size).cast("int").alias("batch")), key)
