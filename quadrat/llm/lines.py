"""Line dedup by pairwise alignment.

Documents are paired through rare lines that they share. A line is rare if ``RARE`` documents hold it at most; each of its holders is
paired with all earlier ones. A document of which half the distinct lines or more stand elsewhere too is a copy of something, even
where it has no rare line, as in large groups of copies: it is paired with the first holder of the rarest line that it shares. Lines that very many
otherwise different documents hold (licences) propose no pair, so they stay.

Every pair is aligned by patience diff. Aligned blocks of ``MIN_WORDS`` words or more are deleted from the later document. Pairs are few: ``RARE`` for
each place of a rare line at most, and one for each document. Lines travel as hashes, whole texts do not; a pair's lines are compared by 64
bits, so that an alignment of foreign lines is not to be expected in any corpus.

Earlier means the smaller id, nulls last, then the smaller hash of the text; rows that agree in both are one
document and get the same result. Defined results: lines without a word do not count; a null text stays null and an empty one empty;
neither has lines; a document all of whose lines are deleted gets the empty text; an empty table gives an empty
result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadrat.llm.common import WORD, Scratch, read, text_batches

#: Words of an aligned block from which it is deleted.
MIN_WORDS = 10
#: Most holders of a rare line.
RARE = 10
#: Documents that lose lines, and lines lost, up to which their list (some 20 MB then) is broadcast.
BROADCAST_ROWS = 300_000
BROADCAST_POSITIONS = 1_500_000


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (later, owner) positions that increases on both sides; ``pairs`` unique on both."""
    pairs = sorted(pairs)
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        if at == len(tails):
            tails.append(y)
            last.append(k)
        else:
            tails[at], last[at] = y, k
        back[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(later: list[int], earlier: list[int]) -> list[tuple[int, int]]:
    """Patience diff of two lists of line hashes, as pairs of positions that increase on both sides.

    Equal lines at the head and tail of a region match; lines that are unique in both sides of what is left are
    put into their longest increasing chain, and the regions between them go on by themselves.
    """
    found: list[tuple[int, int]] = []
    regions = [(0, len(later), 0, len(earlier))]
    while regions:
        x0, x1, y0, y1 = regions.pop()
        while x0 < x1 and y0 < y1 and later[x0] == earlier[y0]:
            found.append((x0, y0))
            x0, y0 = x0 + 1, y0 + 1
        while x0 < x1 and y0 < y1 and later[x1 - 1] == earlier[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
            found.append((x1, y1))
        if x0 == x1 or y0 == y1:
            continue
        here, there = Counter(later[x0:x1]), Counter(earlier[y0:y1])
        place = {h: y for y, h in enumerate(earlier[y0:y1], y0) if there[h] == 1 and here[h] == 1}
        chain = patience([(x, place[h]) for x, h in enumerate(later[x0:x1], x0) if h in place])
        if chain:
            found += chain
            corners = [(x0 - 1, y0 - 1), *chain, (x1, y1)]
            regions += [(a + 1, c, b + 1, d) for (a, b), (c, d) in zip(corners, corners[1:], strict=False) if a + 1 < c and b + 1 < d]
    return sorted(found)


def deletions(later: list[int], words: list[int], earlier: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Positions to delete from the later document: aligned blocks of enough words; line hashes of both, and words of the later one's lines."""
    gone: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for x, y in [*aligned(later, earlier), (1 << 61, 1 << 61)]:
        if (x, y) != (before[0] + 1, before[1] + 1):
            if sum(words[p] for p in block) >= min_words:
                gone += block
            block = []
        block.append(x)
        before = (x, y)
    return gone


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


ORDER = "struct<last:boolean,id:long,th:long>"


def line_hashes(docs: DataFrame) -> DataFrame:
    """(o, t) -> order key, and of its lines with a word, in order, hashes and numbers of words; one row for equal documents."""
    line = F.transform(_lines(F.col("t")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    x = docs.select("o", F.filter(line, lambda x: x["n"] > 0).alias("lines")).where(F.size("lines") > 0)
    return x.select("o", F.col("lines.h").alias("h"), F.col("lines.n").alias("n")).dropDuplicates(["o"])


def proposed(hashed: DataFrame, scratch: Scratch, rare: int = RARE) -> DataFrame:
    """(later, earlier): the pairs of documents to align."""
    places = hashed.select("o", F.explode(F.array_distinct("h")).alias("h"), F.size(F.array_distinct("h")).alias("k"))
    # lines of one document alone are no one's partner; a table of its own, so that Spark can split joins at lines that very many hold
    lines = scratch.save(places.groupBy("h").agg(F.count("*").alias("df"), F.min("o").alias("first")).where("df > 1"), "shared")
    met = scratch.save(places.join(lines, "h"), "met")
    few = met.where(F.col("df") <= rare).select("h", "o")
    pairs = few.join(few.withColumnRenamed("o", "earlier"), "h").where("earlier < o").select(F.col("o").alias("later"), "earlier")
    rarest = met.groupBy("o").agg(F.count("*").alias("m"), F.first("k").alias("k"), F.min(F.struct("df", "h", "first")).alias("least"))
    copies = rarest.where((2 * F.col("m") >= F.col("k")) & (F.col("least.df") > rare) & (F.col("least.first") < F.col("o")))
    return scratch.save(pairs.union(copies.select("o", "least.first")).distinct(), "pairs")


def _aligned_pairs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Later document, its line hashes and words, the earlier one's hashes -> later document, positions to delete."""
        for batch in batches:
            gone = [deletions(*x, min_words) for x in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["o", "gone"])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """Each row of ``docs`` without its text as struct ``row``, the text after deletion as ``clean``, and numbers of lines before and deleted."""
    spark = text_batches(docs).sparkSession
    scratch = Scratch(spark)
    t = F.col(text).cast("string")
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("th"))
    base = docs.select(order.alias("o"), t.alias("t"))
    hashed = scratch.save(line_hashes(base.where("t is not null")), "lines")
    pairs = proposed(hashed, scratch, rare)
    both = pairs.join(hashed.select(F.col("o").alias("earlier"), F.col("h").alias("there")), "earlier").join(hashed.withColumnRenamed("o", "later"), "later")
    found = both.select("later", "h", "n", "there").mapInArrow(_aligned_pairs(min_words), f"o {ORDER}, gone array<int>").where(F.size("gone") > 0)
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")
    decided = scratch.save(found.groupBy("o").agg(gone).select(F.col("o.id").alias("id"), F.col("o.th").alias("th"), "gone"), "decided")
    scratch.drop("lines", "shared", "met", "pairs")
    # a short list of deletions goes to the texts; a long one is joined by shuffle
    n, positions = decided.agg(F.count("*"), F.sum(F.size("gone"))).first()
    if n <= BROADCAST_ROWS and (positions or 0) <= BROADCAST_POSITIONS:
        decided = F.broadcast(decided)
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    rows = docs.select(F.struct(*rest).alias("row"), t.alias("t"), F.col(key).cast("long").alias("k"), F.xxhash64(t).alias("kh"))
    rows = rows.join(decided, F.col("k").eqNullSafe(F.col("id")) & (F.col("kh") == F.col("th")), "left")
    has = F.transform(_lines(F.col("t")), lambda x: F.regexp_like(x, F.lit(WORD)))
    n_lines = F.when(F.col("t").isNotNull(), F.size(F.filter(has, lambda x: x)))
    # only texts that lose lines go to Python
    clean = F.coalesce(_without(F.when(F.col("gone").isNotNull(), F.col("t")), "gone"), "t")
    n_deleted = F.when(F.col("gone").isNotNull(), F.size("gone"))
    return rows.select("row", clean.alias("clean"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(n_deleted, F.lit(0)).cast("long").alias("n_deleted"))


@F.arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Lines with a word are numbered; those in ``gone`` go, and blank lines stay with what is left."""
    out = []
    for text, drop in zip(texts, gone, strict=True):
        text, drop = text.as_py(), drop.as_py()
        if drop is None or text is None:
            out.append(text)
            continue
        drop, kept, p = set(drop), [], 0
        for line in text.split("\n"):
            if not line.strip(" \t\n\r\x0b\x0c"):
                kept.append(line)
                continue
            if p not in drop:
                kept.append(line)
            p += 1
        out.append("\n".join(kept) if p > len(drop) else "")
    return pa.array(out, pa.string())


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left, and its numbers of lines before and deleted."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("row.doc_id", F.col("clean").alias("text"), "n_lines", "n_deleted")
