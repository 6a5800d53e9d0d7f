"""Mixing sources to target weights by capped water-filling.

``targets`` gives every source a share of the budget in proportion to its weight, stops it at
``max_epochs`` times its size and hands the excess to the others by weight until none is above.
``plan`` turns a target into whole repetitions of all documents plus a fractional one: documents are
ordered by a seeded digest of their id, and those up to a cut take one repetition more. The cut is
one key per source, so deciding costs one narrow pass for sums by (source, digest prefix), one over
the few documents near the cut, and none of the texts are shuffled. A hot source is spread over
4,096 prefixes, so that no task holds it whole. Rows that agree in source, id and size are one group
there, which the cut may part: then its rows are written with numbers and as many as are due take the repetition, the first
ones, found by counts for each partition of that table and a sort within one of them.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
source of size 0 gets target 0 and its documents one repetition less than any other's (none).
Empty tables give empty results. Extra columns pass through ``mix``; ``reps``-named ones are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm.common import WORD, Scratch, read

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: A plan of up to this many sources (some 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: str | Column = "text") -> Column:
    """Words of a text; its JVM regular expression keeps the scan in one stage."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with weight and target; one row for each source.

    With sources ordered by cap over weight, those before some place are clamped at their cap and
    the rest get what is left in proportion to weight: running sums find the place, no iteration.
    The windows run over the list of sources, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(all_rows) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.max(F.when(F.col("free"), F.col("level"))).over(all_rows)
    first_free = F.min(F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(all_rows)
    clamped = first_free.isNull() | (F.col("cap") / F.col("weight") < first_free)
    target = F.when(clamped, F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(items: DataFrame, **options) -> DataFrame:
    """(source, key, size) -> one row per source with its target, whole repetitions and cut.

    A document takes ``whole`` repetitions, and one more if (digest, key, size) <= (cut_d, cut_k, cut_n); of the
    group ``parted``, as many documents as are ``due`` do.
    """
    x = items.withColumn("d", _digest("key")).withColumn("bucket", F.substring("d", 1, 3))
    # at most 4,096 rows for each source, written once: texts are counted here, near the cuts and where the plan is applied
    scratch = Scratch(items.sparkSession)
    sums = scratch.save(x.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "sums")
    source = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **options)
    source = source.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    source = source.withColumn("whole", F.floor("rate").cast("int")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    near = sums.withColumn("below", F.coalesce(F.sum("n").over(run), F.lit(0))).select(F.col("source").alias("ns"), F.col("bucket").alias("nb"), "below", "n")
    near = near.join(source.select("source", "extra"), F.col("ns").eqNullSafe(F.col("source")))
    near = near.where((F.col("below") < F.col("extra")) & (F.col("extra") <= F.col("below") + F.col("n"))).select("ns", "nb", "below", "extra")
    inside = x.join(F.broadcast(near) if _few(near) else near, F.col("source").eqNullSafe(F.col("ns")) & (F.col("bucket") == F.col("nb")))
    # rows that agree are one group; the row at the boundary is taken if more than half of it is inside
    inside = inside.groupBy("ns", "below", "extra", "d", "key", "size").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("ns").orderBy("d", F.col("key").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("extra") - F.col("below") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(upto), F.lit(0))
    due = F.when(F.col("size") == 0, F.when(room >= 0, F.col("m")).otherwise(0)).otherwise(F.floor(room / F.col("size") + 0.5))
    inside = inside.withColumn("due", F.greatest(F.lit(0), F.least("m", due)).cast("long"))
    group = F.struct("d", F.col("key").isNotNull().alias("has"), "key", "size")
    whole_groups = F.max(F.when(F.col("due") == F.col("m"), group)).alias("cut")
    parted = F.max(F.when((F.col("due") > 0) & (F.col("due") < F.col("m")), F.struct(*[group[c].alias(c) for c in ("d", "has", "key", "size")], "due"))).alias("parted")
    cut = inside.groupBy(F.col("ns").alias("cs")).agg(whole_groups, parted)
    low = near.select("ns", "nb").join(cut, F.col("ns").eqNullSafe(F.col("cs")), "left").select("ns", "nb", "cut", "parted")
    out = source.join(low, F.col("source").eqNullSafe(F.col("ns")), "left")
    # without a group in the cut's bucket that is taken whole, the cut is the bucket's lower edge
    out = out.select("source", "source_size", "target", "whole", F.coalesce(F.col("cut.d"), F.col("nb"), F.lit("")).alias("cut_d"), F.col("cut.has").alias("cut_has"), F.col("cut.key").alias("cut_k"), F.col("cut.size").alias("cut_n"), "parted")
    out = scratch.save(out, "plan")
    scratch.drop("sums")
    return out


def _first_rows(parted: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows of parted groups (source, due, number) -> (ps, last): the number up to which ``due`` rows of each source stand."""
    part = F.shiftrightunsigned("number", 33)
    counts = scratch.save(parted.groupBy(F.col("source").alias("ps"), "due", part.alias("part")).agg(F.count("*").alias("k")), "parts")
    run = Window.partitionBy("ps").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.withColumn("before", F.coalesce(F.sum("k").over(run), F.lit(0))).where("before < due and due <= before + k")
    at = at.select("ps", "part", (F.col("due") - F.col("before")).alias("nth"))
    inside = parted.select("source", "number").join(F.broadcast(at) if _few(at) else at, F.col("source").eqNullSafe(F.col("ps")) & (part == F.col("part")))
    # the rows of one partition of the table for each source
    inside = inside.withColumn("n", F.row_number().over(Window.partitionBy("ps").orderBy("number")))
    return inside.where("n = nth").select("ps", F.col("number").alias("last"))


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def repetitions(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as a struct ``row`` with size, source_size, target and reps of each."""
    narrow = docs.select(F.col(source).alias("source"), F.col(key).alias("key"), size_of(F.col(text)).alias("size"))
    p = plan(narrow, **options)
    parts = not p.where("parted is not null").isEmpty()
    p = F.broadcast(p) if _few(p) else p
    x = docs.select(F.struct("*").alias("row"), F.col(source).alias("s"), F.col(key).alias("key"), size_of(F.col(text)).alias("size")).withColumn("d", _digest("key"))
    joined = x.join(p, F.col("s").eqNullSafe(F.col("source")))
    has = F.col("key").isNotNull()
    at = F.struct(F.coalesce("cut_k", F.lit(0)), "cut_n")
    below = (F.col("d") < F.col("cut_d")) | ((F.col("d") == F.col("cut_d")) & ((has < F.col("cut_has")) | ((has == F.col("cut_has")) & (F.struct(F.coalesce("key", F.lit(0)), "size") <= at))))
    result = lambda df, more: df.select("row", "size", "source_size", "target", (F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")).alias("reps"))
    if not parts:
        return result(joined, below)
    # rows of parted groups are written with numbers, so that the numbers stay the same
    mine = (F.col("d") == F.col("parted.d")) & F.col("key").eqNullSafe(F.col("parted.key")) & (F.col("size") == F.col("parted.size"))
    mine = F.coalesce(mine, F.lit(False))
    scratch = Scratch(docs.sparkSession)
    group = joined.where(mine).select("row", "size", "source", "source_size", "target", "whole", F.col("parted.due").alias("due"), F.monotonically_increasing_id().alias("number"))
    group = scratch.save(group, "group")
    last = _first_rows(group, scratch)
    group = group.join(F.broadcast(last) if _few(last) else last, F.col("source").eqNullSafe(F.col("ps")), "left")
    return result(joined.where(~mine), below).union(result(group, F.col("number") <= F.col("last")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each document as many times as its repetitions say, with the columns of ``docs``."""
    r = repetitions(docs, **options).where("reps > 0")
    return r.select("row", F.explode(F.sequence(F.lit(1), "reps"))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words of it that the mix takes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    r = repetitions(docs)
    return r.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).cast("long").alias("taken"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, cap / weight AS ratio,
             (sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER x, 0) AS rest,
             (sum(weight) OVER ()) - coalesce(sum(weight) OVER x, 0) AS rest_w
      FROM w WINDOW x AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest / rest_w AS level, rest / rest_w * weight <= cap AS free FROM b),
g AS (SELECT *, max(level) FILTER (free) OVER () AS lv, min(ratio) FILTER (free) OVER () AS fr FROM f),
t AS (SELECT source, source_size, CASE WHEN fr IS NULL OR ratio < fr THEN cap ELSE least(cap, lv * weight) END AS target FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM t),
e AS (SELECT *, target - whole * source_size AS extra FROM r),
j AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.extra, d.h, e.source,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN extra > 0 AND upto - size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
