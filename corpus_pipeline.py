"""A training-data pipeline over ``documents``: each stage is written as Parquet and read again.

Every stage works on all that its predecessor kept, its decisions take effect, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import lines, mixing, ngram_join, pieces, quality
from quadrat.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    row = F.struct(*docs.columns)
    return quality.cascade(docs.select(row.alias("row"), "text")).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier document holds; one that loses all its lines goes.

    ``n_chars`` is counted anew for texts that lost lines.
    """
    left = lines.dedup(docs).where("n_lines = 0 or n_deleted < n_lines")
    of = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("clean")}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("n_deleted") > 0, F.char_length("clean")).otherwise(of["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*[of[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar sets of n-grams connect: the one with the smallest id, then the smallest hash of its text.

    A document is its id with its text: another text under the same id is judged by itself, and of rows equal in both one
    stays. Documents without words stay, as do groups none of whose documents has an id.
    """
    scratch = Scratch(spark)
    found = ngram_join.join(docs, hashed=True).where("n_shingles > 0 and component_id is not null")
    found = found.groupBy("doc_id", "th", "component_id").agg(F.count("*").alias("rows"))
    found = scratch.save(found, "found")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"))
    found = found.join(first, "component_id")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    gone, repeated = found.where(~stays).select("doc_id", "th"), found.where(stays & (F.col("rows") > 1)).select("doc_id", "th")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), ngram_join.text_hash("text").alias("h"))
    same = lambda keys: F.col("id").eqNullSafe(keys["doc_id"]) & (F.col("h") == keys["th"])
    if repeated.isEmpty():
        return d.join(gone, same(gone), "left_anti").select("row.*")
    rest = scratch.save(gone.union(repeated), "rest")
    once = d.join(repeated, same(repeated), "left_semi").groupBy("id", "h").agg(F.min("row").alias("row"))
    return d.join(rest, same(rest), "left_anti").select("row.*").union(once.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


#: Lattices that a task keeps: few, as the stages before have filled the executors.
STAGE_CACHE = 100_000


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document of the mixture; repetitions of a document draw their own."""
    return pieces.encode(docs, copies=True, cache=STAGE_CACHE).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Patience alignment and sampling from a lattice have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result is returned unwritten."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
