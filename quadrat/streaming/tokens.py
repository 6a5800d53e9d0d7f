"""Rank tokens of a stream of samples, one row per sample, with fitted parameters.

Ranking by window functions needs the whole input; an array per sample can be sorted in place, so the same
expression serves a stream and a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.tokens import FIRST, PAD


def rank_array(cells: Column, max_len: int) -> Column:
    """array<struct<feature_idx, abundance>> -> ids, padded to max_len; ties by feature index."""
    detected = F.filter(cells, lambda c: c["abundance"] > 0)
    keyed = F.array_sort(F.transform(detected, lambda c: F.struct((-c["abundance"]).alias("a"), c["feature_idx"].alias("i"))))
    ids = F.transform(F.slice(keyed, 1, max_len), lambda c: (c["i"] + FIRST).cast("long"))
    return F.concat(ids, F.array_repeat(F.lit(PAD).cast("long"), F.lit(max_len) - F.size(ids)))


def tokenize(samples: DataFrame, max_len: int = 256, cells: str = "cells") -> DataFrame:
    """Works on ``readStream`` and ``read`` alike; stateless, so any output mode and trigger will do."""
    return samples.withColumn("ids", rank_array(F.col(cells), max_len))


def arrivals(samples: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Samples counted by study in tumbling windows; those later than the watermark are left out."""
    return samples.withWatermark(time, late).groupBy(F.window(time, every), "study_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "study_name", "n")
