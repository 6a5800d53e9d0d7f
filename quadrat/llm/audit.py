"""How filters of documents act on each other, in every order of applying them.

Duplicates are found by sorting: documents are range-sorted by text fingerprint, with the whole text and doc_id deciding
within a range, and each is compared with its predecessor. Ranges are cut by fingerprint and doc_id, so that a text that a third of all
rows hold is spread over many tasks. Only the texts with a range's first fingerprint may have begun in a range before: those of
their rows that no predecessor decides are held against the smallest ids of the texts at the ends of all ranges, in one small join.

Every document ends as a mask of the filters that it fails. Masks are counted by part, with the good and the toxic among
them: at most 128 additive counters a part, which later increments could be added to. All numbers of all 120 orders follow from these.

Defined results: a null text is empty; a null part is the empty string, as is an empty one; a null doc_id is not smaller than
any and no doc_id is smaller than it, so that its row is no duplicate and makes none; rows that agree in text and doc_id are no
duplicates of each other; a document labelled more than once is good (toxic) if any label says so; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, partitions, read, text_batches

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
# Letters of the filters, and characters of which filter D allows none.
FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
A, B, C, D, E = (1 << k for k in range(5))

_UPPER = bytes(range(65, 91))
_SYMBOLS = SYMBOLS.encode()


def failures(text: str, data: bytes) -> int:
    """Mask of the filters A to D that a text fails; ``data`` is the text in UTF-8."""
    words = data.split()
    mask = A if len(words) < MIN_WORDS else 0
    if 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words):
        mask |= B
    if 100 * (len(data) - len(data.translate(None, _UPPER))) > MAX_UPPER_PERCENT * len(text):
        mask |= C
    if len(data.translate(None, _SYMBOLS)) < len(data):
        mask |= D
    return mask


#: kind 0: a document, decided. kind 1: a document whose text may have begun in a range before. kind 2: a text at the end of a range with its smallest id.
MARKS = "kind int, doc_id long, part string, mask int, n long, fp long, text string"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted: fp, text, doc_id, part. Each is compared with its predecessor."""
    names = ["kind", "doc_id", "part", "mask", "n", "fp", "text"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    first = fp_now = None
    text_now, least = None, None
    heads: list[tuple[int, str, int]] = []  # texts of the first fingerprint, then of the last
    unsure: dict[tuple, int] = defaultdict(int)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    tail: list[tuple[int, str, int]] = []
    mask = 0
    for batch in batches:
        rows = []
        for fp, text, doc_id, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if fp != fp_now or text != text_now:
                if text_now is not None and least is not None:
                    (heads if fp_now == first else tail).append((fp_now, text_now, least))
                if first is None:
                    first = fp
                if fp != fp_now:
                    tail = []
                fp_now, text_now, least = fp, text, None
                mask = failures(text, text.encode("utf-8", "surrogatepass"))
            if doc_id is not None and least is None:
                least = doc_id
            repeats = doc_id is not None and doc_id > least
            decided = repeats or doc_id is None or fp != first
            if decided:
                rows.append((0, doc_id, part, mask | (E if repeats else 0), 1, None, None))
            else:
                unsure[doc_id, part, mask, fp, text] += 1
        yield out(rows)
    for i, p, m, fp, t in unsure:
        yield out([(1, i, p, m, unsure[i, p, m, fp, t], fp, t)])
    if text_now is not None and least is not None:
        (heads if fp_now == first else tail).append((fp_now, text_now, least))
    for k in range(0, len(heads) + len(tail), 1000):
        yield out([(2, i, None, None, None, fp, t) for fp, t, i in (heads + tail)[k : k + 1000]])


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): the filters that n documents fail, which agree in all of these; mostly one document a row."""
    spark = text_batches(docs).sparkSession
    scratch = Scratch(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    x = docs.select(F.xxhash64(t).alias("fp"), t.alias("text"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    # ranges are cut by numbers, so that no text is sampled, and may part repeated rows too; a range is then sorted by fingerprint, text and id
    x = x.withColumn("row", F.monotonically_increasing_id() % 1024)
    ranged = x.repartitionByRange(partitions(spark), "fp", "doc_id", "row").sortWithinPartitions("fp", "text", "doc_id")
    marked = scratch.save(ranged.mapInArrow(_compared, MARKS), "marked")
    decided = marked.where("kind = 0").select("doc_id", "part", "mask", "n")
    begun = marked.where("kind = 2").groupBy("fp", "text").agg(F.min("doc_id").alias("least"))
    unsure = marked.where("kind = 1").join(begun, ["fp", "text"])
    late = F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("least"), E).otherwise(0))
    return decided.union(unsure.select("doc_id", "part", late.alias("mask"), "n"))


def counters(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask) -> n, good, toxic. Counters of disjoint sets of documents may be added."""
    # only labels that count, one for each document
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long")).alias(c)
    of = labels.where(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    of = of.groupBy(F.col(key).cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    x = masked.join(of, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long") * F.col("n"))
    return x.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def _orders() -> tuple[list[str], list[int], list[int]]:
    """All orders of the filters; for each order and step the filter's bit and those of the filters before it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = [1 << FILTERS.index(c) for o in orders for c in o]
    before = [sum(bits[5 * k : 5 * k + s]) for k in range(len(orders)) for s in range(5)]
    return orders, bits, before


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counters."""
    orders, bits, before = _orders()
    lit = lambda values: F.array(*[F.lit(v) for v in values])
    every = F.sequence(F.lit(0), F.lit(31))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    p = counts.groupBy("part").agg(by_mask.alias("m"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    p = p.select("part", F.transform(every, lambda k: F.coalesce(F.try_element_at("m", k), zero)).alias("m"))
    x = p.select("part", "m", F.explode(F.sequence(F.lit(0), F.lit(5 * len(orders) - 1))).alias("at"))
    x = x.select("part", "m", "at", F.element_at(lit(bits), F.col("at") + 1).alias("bit"), F.element_at(lit(before), F.col("at") + 1).alias("before"))

    def over(field: str, holds) -> Column:
        """Sum of a counter over the masks for which ``holds``."""
        hit = lambda k: F.when(holds(k), F.get("m", k)[field]).otherwise(F.lit(0).cast("long"))
        return F.aggregate(every, F.lit(0).cast("long"), lambda acc, k: acc + hit(k))

    fails = lambda k: k.bitwiseAND(F.col("bit")) != 0
    gone = lambda k: k.bitwiseAND(F.col("before")) != 0
    here = lambda k: fails(k) & ~gone(k)
    # of all orders, a filter comes first among the k that a document fails in one of k
    share = lambda k: F.when(fails(k), F.get("m", k)["n"] * (F.lit(len(orders)) / F.bit_count(k)).cast("long")).otherwise(F.lit(0).cast("long"))
    return x.select(
        "part",
        F.element_at(lit(orders), (F.col("at") / 5).cast("int") + 1).alias("filter_order"),
        (F.col("at") % 5 + 1).cast("int").alias("step"),
        over("n", lambda k: ~fails(k) & ~gone(k)).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda k: fails(k) & gone(k)).alias("redundant"),
        F.get("m", F.col("bit"))["n"].alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        F.aggregate(every, F.lit(0).cast("long"), lambda acc, k: acc + share(k)).alias("shapley"),
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's counts for all orders and steps."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return interactions(counters(masks(docs), labels))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
m AS (SELECT doc_id, part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
             100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS C,
             regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN l USING (doc_id)),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM f a, f b, f x, f y, f z
      WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
             list_sum([0] || [1 << (ascii(filter_order[k]) - 65) FOR k IN range(1, step)])::INT AS before
      FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, bit,
             sum((mask & (bit | before) = 0)::INT)::BIGINT AS kept,
             sum((mask & bit <> 0 AND mask & before = 0)::INT)::BIGINT AS removed,
             sum((mask & bit <> 0 AND mask & before <> 0)::INT)::BIGINT AS redundant,
             sum((mask = bit)::INT)::BIGINT AS unique_fails,
             sum((mask & bit <> 0 AND mask & before = 0)::INT * good)::BIGINT AS good_lost,
             sum((mask & bit <> 0 AND mask & before = 0)::INT * toxic)::BIGINT AS toxic_lost
      FROM d, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
