"""Cohort summaries, data for plots, and principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.ranking import quantiles


def summary(df: DataFrame, value: str, subject: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(subject).alias("n_subjects"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts of values, NULL left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def bars(df: DataFrame, column: str) -> DataFrame:
    """Counts of values as bars: the tallest first, equal ones by value, with their place and label."""
    n = frequencies(df, column)
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc(column)))  # one row for each value
    total = F.sum("n").over(Window.partitionBy())
    return n.select(column, "n", place.alias("place"), F.format_string("%d (%.1f%%)", F.col("n"), 100 * F.col("n") / total).alias("label"))


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """(bin, low, n): bins of equal width over the range, the last one closed. Empty bins have no row."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    x = df.where(F.col(value).isNotNull()).join(F.broadcast(r)).select(at.alias("bin"), "lo", width.alias("w"))
    return x.groupBy("bin").agg(F.first(F.col("lo") + F.col("bin") * F.col("w")).alias("low"), F.count("*").alias("n"))


def box(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 interquartile ranges) and number of outliers of each group."""
    x = df.where(F.col(value).isNotNull())
    q = quantiles(x, value, [0.25, 0.5, 0.75], [group])
    q = q.select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return x.join(q, group).groupBy(group, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("long")).alias("n_outliers"))


def lookup(left: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Left join with the first row of each key."""
    first = table.groupBy(key).agg(F.min_by(F.struct(value), F.struct(order, value)).alias("_f")).select(key, F.col("_f")[value].alias(value))
    return left.join(first, key, "left")


def pca(df: DataFrame, vector: Column, key: str, k: int = 3) -> tuple[DataFrame, list[float]]:
    """(key, pc) with the first k components of centred and scaled vectors, and their shares of variance. Signs are arbitrary."""
    x = df.select(key, array_to_vector(vector.cast("array<double>")).alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(x).transform(x)
    model = PCA(k=k, inputCol="s", outputCol="pc").fit(scaled)
    return model.transform(scaled).select(key, vector_to_array("pc").alias("pc")), [float(v) for v in model.explainedVariance]


def with_metadata(scores: DataFrame, metadata: DataFrame, key: str = "sample_id", k: int = 2) -> DataFrame:
    """The first k components as columns pc1, pc2, ... beside the samples' metadata; unknown samples have NULL there."""
    return scores.select(key, *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)]).join(metadata, key, "left")


def ellipses(points: DataFrame, group: str, x: str, y: str, level: float = 0.68) -> DataFrame:
    """Normal-theory confidence ellipse of each group, from its five moments: centre, half axes, angle."""
    m = points.groupBy(group).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.var_samp(y).alias("yy"))
    radius = float(np.sqrt(-2 * np.log(1 - level)))

    def axes(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c = np.array([[r.xx, r.xy], [r.xy, r.yy]], float)
                value, vector = np.linalg.eigh(c) if np.isfinite(c).all() else (np.full(2, np.nan), np.full((2, 2), np.nan))
                rows.append((r[0], r.cx, r.cy, radius * np.sqrt(max(value[1], 0)) if value[1] == value[1] else np.nan, radius * np.sqrt(max(value[0], 0)) if value[0] == value[0] else np.nan, float(np.arctan2(vector[1, 1], vector[0, 1]))))
            yield pd.DataFrame(rows, columns=[group, "cx", "cy", "major", "minor", "angle"])

    kind = points.schema[group].dataType.simpleString()
    return m.mapInPandas(axes, f"`{group}` {kind}, cx double, cy double, major double, minor double, angle double")
