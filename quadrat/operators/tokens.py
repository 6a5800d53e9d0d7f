"""Samples as token sequences: ranks by abundance, with bins or continuous values.

Token ids: 0 pads, 1 masks, the feature with index i is i + 2. Sequences stay exploded (one row per token), all
on the samples' shuffle; ``padded`` makes arrays at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.ranking import quantiles
from quadrat.functions.scalars import digitize
from quadrat.operators import composition

PAD, MASK, FIRST = 0, 1, 2
#: Decimals to which log-ratios are rounded before edges are fitted and applied.
DIGITS = 9


def rank(rel: DataFrame, max_len: int = 256, min_abundance: float = 0.0) -> DataFrame:
    """Detected features of each sample by share, largest first; equal shares by feature index. Top-k per sample: the
    planner limits each group before the shuffle's sort ends."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("rel"), F.asc("feature_idx"))
    x = rel.where(F.col("rel") > min_abundance).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_len)
    return x.withColumn("rank", F.col("_r") - 1).withColumn("token_id", (F.col("feature_idx") + FIRST).cast("long")).drop("_r")


def probabilities(n_bins: int) -> list[float]:
    return [k / n_bins for k in range(1, n_bins)]


def bin_edges(with_clr: DataFrame, model: composition.Composition, n_bins: int = 10, population: str = "all") -> DataFrame:
    """One row: interior quantiles of all non-zero log-ratios. ``all`` counts each sample's undetected cells by weight."""
    x = with_clr.select("clr", F.lit(1).alias("n"))
    if population == "all":
        x = x.unionByName(composition.zero_cells(with_clr, model).select("clr", F.col("n").cast("int").alias("n")))
    return quantiles(x.where("clr <> 0"), "clr", probabilities(n_bins), weight="n").select(F.col("q").alias("edges"))


def bins(tokens: DataFrame, edges: list[float]) -> DataFrame:
    return tokens.withColumn("bin", digitize(F.col("clr"), F.array(*[F.lit(e) for e in edges])))


def cont_stats(tokens: DataFrame) -> DataFrame:
    """One row: mean and population deviation of non-zero token values."""
    return tokens.where("clr <> 0").agg(F.avg("clr").alias("mean"), (F.stddev_pop("clr") + 1e-8).alias("std"))


def padded(tokens: DataFrame, max_len: int, value: Column | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Arrays ids, ranks, vals of length max_len; ``samples`` keeps those without tokens, as padding only."""
    val = F.lit(0).cast("double") if value is None else value.cast("double")
    x = tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("token_id").alias("id"), val.alias("val")))).alias("t"))
    if samples is not None:
        x = samples.select("sample_id").distinct().join(x, "sample_id", "left")
    n = F.coalesce(F.size("t"), F.lit(0))
    n = F.when(F.col("t").isNull(), 0).otherwise(n)
    fill = lambda field, zero: F.concat(F.coalesce(F.col(f"t.{field}"), F.array().cast(f"array<{zero}>")), F.array_repeat(F.lit(0).cast(zero), F.lit(max_len) - n))
    return x.select("sample_id", fill("id", "bigint").alias("ids"), fill("rank", "int").alias("ranks"), fill("val", "double").alias("vals"), n.alias("n_tokens"))


@dataclass(frozen=True)
class Tokenizer:
    """Everything that is fitted: composition, and edges or moments of the value mode."""

    composition: composition.Composition
    mode: str
    max_len: int
    edges: tuple[float, ...] = ()
    mean: float = 0.0
    std: float = 1.0

    @property
    def vocab_size(self) -> int:
        return self.composition.p + FIRST

    def transform(self, cells: DataFrame) -> DataFrame:
        """(sample_id, feature_idx, abundance) -> sample_id, rank, token_id, val."""
        x = composition.clr(composition.relative(cells), self.composition, DIGITS)
        t = rank(x, self.max_len)
        if self.mode == "rank":
            return t.select("sample_id", "rank", "token_id", F.lit(0).cast("double").alias("val"))
        if self.mode == "bin":
            return bins(t, list(self.edges)).select("sample_id", "rank", "token_id", F.col("bin").cast("double").alias("val"))
        val = F.when(F.col("clr") == 0, 0.0).otherwise((F.col("clr") - self.mean) / self.std)
        return t.select("sample_id", "rank", "token_id", val.alias("val"))


def fit(cells: DataFrame, features: DataFrame, mode: str = "bin", max_len: int = 256, n_bins: int = 10, edges: list[float] | None = None, pseudo: str | float = "half_min") -> Tokenizer:
    if mode not in ("rank", "bin", "cont"):
        raise ValueError(f"unknown value mode: {mode}")
    rel = composition.relative(cells)
    model = composition.fit(rel, features, pseudo)
    x = composition.clr(rel, model, DIGITS)
    if mode == "bin":
        found = edges if edges is not None else bin_edges(x, model, n_bins).first().edges
        return Tokenizer(model, mode, max_len, tuple(found or ()))
    if mode == "cont":
        s = cont_stats(rank(x, max_len)).first()
        return Tokenizer(model, mode, max_len, mean=s.mean or 0.0, std=s.std or 1.0)
    return Tokenizer(model, mode, max_len)


def mask(tokens: DataFrame, draw: Column, ratio: float = 0.15, mode: str = "bin") -> DataFrame:
    """Replaces a share of each sample's tokens by MASK, the first one if none was drawn. Adds ``selected`` and ``target``."""
    drawn = draw < ratio
    none = ~F.bool_or(drawn).over(Window.partitionBy("sample_id"))
    x = tokens.withColumn("selected", drawn | (none & (F.col("rank") == 0))).withColumn("target", F.col("token_id"))
    x = x.withColumn("token_id", F.when(F.col("selected"), F.lit(MASK)).otherwise(F.col("token_id")).cast("long"))
    return x if mode == "rank" else x.withColumn("val", F.when(F.col("selected"), 0.0).otherwise(F.col("val")))
