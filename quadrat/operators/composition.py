"""Relative abundances, pseudocount, centred log-ratio and prevalence, on sparse cells.

For a sample with k of P features detected, the mean log is (sum of ln(rel + eps) over detected cells + (P - k) ln eps) / P;
so the centred log-ratio of every undetected feature is one number per sample and no dense table is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Used where no cell is positive.
FALLBACK_EPS = 1e-6


def by_sample():
    return Window.partitionBy("sample_id")


def relative(cells: DataFrame, to: float = 1.0) -> DataFrame:
    """Adds ``rel``: shares of the sample; a sample that sums to zero stays zero."""
    total = F.sum("abundance").over(by_sample())
    return cells.withColumn("rel", F.when(total == 0, 0.0).otherwise(F.col("abundance") / total * to))


def half_min(rel: DataFrame) -> DataFrame:
    """One row: half the least positive share of the whole table."""
    return rel.where("rel > 0").agg(F.coalesce(F.min("rel") / 2, F.lit(FALLBACK_EPS)).alias("eps"))


@dataclass(frozen=True)
class Composition:
    """Fitted scalars: pseudocount and number of features."""

    eps: float
    p: int

    def __post_init__(self):
        if not self.eps > 0:
            raise ValueError("the pseudocount must be positive")


def fit(rel: DataFrame, features: DataFrame, pseudo: str | float = "half_min") -> Composition:
    if isinstance(pseudo, str) and pseudo != "half_min":
        raise ValueError(f"unknown pseudocount: {pseudo}")
    eps = half_min(rel).first().eps if pseudo == "half_min" else float(pseudo)
    return Composition(float(eps), features.count())


def clr(rel: DataFrame, model: Composition, digits: int | None = None) -> DataFrame:
    """Adds ``clr`` of detected cells and ``clr_zero`` of the sample's undetected ones. One window over the samples' shuffle."""
    detected = rel.where("rel > 0")
    log = F.log(F.col("rel") + F.lit(model.eps))
    log_eps = F.log(F.lit(model.eps))
    k = F.count("*").over(by_sample())
    mean = (F.sum(log).over(by_sample()) + (F.lit(model.p) - k) * log_eps) / F.lit(model.p)
    x = detected.withColumn("clr", log - mean).withColumn("clr_zero", log_eps - mean).withColumn("n_detected", k)
    if digits is not None:
        x = x.withColumn("clr", F.round("clr", digits)).withColumn("clr_zero", F.round("clr_zero", digits))
    return x


def zero_cells(with_clr: DataFrame, model: Composition) -> DataFrame:
    """Per sample: the value of its undetected cells and how many there are."""
    return with_clr.groupBy("sample_id").agg(F.first("clr_zero").alias("clr"), (F.lit(model.p) - F.first("n_detected")).alias("n")).where("n > 0")


def prevalence(cells: DataFrame, n_samples: int) -> DataFrame:
    """Share of all samples with each feature; a sample has one cell of a feature, so cells are counted."""
    return cells.where("abundance > 0").groupBy("feature").agg(F.count("*").alias("n")).withColumn("prevalence", F.col("n") / F.lit(n_samples))


def prevalence_filter(cells: DataFrame, n_samples: int, least: float = 0.10) -> DataFrame:
    """Cells of features that at least this share of all samples has; samples without cells count too."""
    keep = prevalence(cells, n_samples).where(F.col("prevalence") >= least).select("feature")
    return cells.join(keep, "feature", "left_semi")


def zero_variance_filter(values: DataFrame, value: str = "value") -> DataFrame:
    keep = values.groupBy("feature").agg(F.stddev_samp(value).alias("sd")).where("sd > 0").select("feature")
    return values.join(keep, "feature", "left_semi")


def mean_impute(values: DataFrame, by: str = "feature", value: str = "value") -> DataFrame:
    """NULL, here not measured, becomes the mean of what was measured."""
    mean = F.avg(value).over(Window.partitionBy(by))
    return values.withColumn(value, F.coalesce(F.col(value), mean))
