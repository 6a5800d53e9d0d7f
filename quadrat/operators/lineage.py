"""Lineage labels of features, adjacency as equality of labels, and attention allowed by it.

Adjacency is an equivalence relation: it is kept as labels and never as pairs of features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.tokens import FIRST


def first_per_key(lineage: DataFrame, key: str = "taxon", order: str = "src_row") -> DataFrame:
    """The first row of each key in file order; NULL keys are equal. Minima combine before the shuffle."""
    rows = lineage.select(key, F.struct(F.col(order), F.struct("*")).alias("_o"), F.struct("*").alias("_row"))
    return rows.groupBy(key).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def labels(features: DataFrame, lineage: DataFrame, level: str = "family", key: str | None = None) -> DataFrame:
    """feature_idx, feature, label at a rank; what is not found has a label of its own."""
    lineage = lineage.toDF(*[c.lower() for c in lineage.columns])
    key = key or ("taxon" if "taxon" in lineage.columns else lineage.columns[-1])
    if level == key:
        raise ValueError("the rank is the key itself")
    if level not in lineage.columns:  # an absent rank is unknown of every feature
        lineage = lineage.withColumn(level, F.lit(None).cast("string"))
    if "src_row" not in lineage.columns:
        lineage = lineage.withColumn("src_row", F.monotonically_increasing_id())
    one = first_per_key(lineage, key).select(F.col(key).alias("feature"), F.col(level).alias("label"))
    return features.join(one, "feature", "left").select("feature_idx", "feature", F.coalesce("label", F.concat(F.lit("__unknown__"), F.col("feature").cast("string"))).alias("label"))


def adjacency(labelled: DataFrame) -> DataFrame:
    """Pairs of features with equal labels, for small vocabularies that need them."""
    a, b = labelled.select(F.col("feature_idx").alias("i"), "label"), labelled.select(F.col("feature_idx").alias("j"), "label")
    return a.join(b, "label").select("i", "j")


def density(labelled: DataFrame) -> DataFrame:
    """Share of adjacent pairs, from label counts."""
    c = labelled.groupBy("label").agg(F.count("*").alias("c"))
    return c.agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), 2)).alias("density"))


def attention(tokens: DataFrame, labelled: DataFrame, allow_global: bool = True) -> DataFrame:
    """Per pair of a sample's tokens, whether row may look at column. PAD and MASK are not real: such rows see all, and
    such columns are seen by all (under ``allow_global``, as are tokens by themselves)."""
    with_label = tokens.join(labelled.select((F.col("feature_idx") + FIRST).cast("long").alias("token_id"), "label"), "token_id", "left")
    first = labelled.where("feature_idx = 0").select(F.col("label").alias("zero"))
    side = with_label.join(F.broadcast(first)).select("sample_id", "rank", (F.col("token_id") >= FIRST).alias("real"), F.when(F.col("token_id") >= FIRST, F.col("label")).otherwise(F.col("zero")).alias("label"))
    a = side.select("sample_id", F.col("rank").alias("i"), F.col("real").alias("ri"), F.col("label").alias("li"))
    b = side.select("sample_id", F.col("rank").alias("j"), F.col("real").alias("rj"), F.col("label").alias("lj"))
    allowed = (F.col("li") == F.col("lj")) | ~F.col("ri")
    if allow_global:
        allowed = allowed | (F.col("i") == F.col("j")) | ~F.col("rj")
    return a.join(b, "sample_id").select("sample_id", "i", "j", allowed.alias("allowed"))


def attention_counts(tokens: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per sample the pairs allowed and in all, from label counts: no pairs are made. Real tokens only."""
    x = tokens.join(labelled.select((F.col("feature_idx") + FIRST).cast("long").alias("token_id"), "label"), "token_id")
    c = x.groupBy("sample_id", "label").agg(F.count("*").alias("c"))
    return c.groupBy("sample_id").agg(F.sum(F.col("c") * F.col("c")).cast("long").alias("n_allowed"), (F.sum("c") * F.sum("c")).cast("long").alias("n_pairs"))
