"""Column expressions that several operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_PREFIXES = {"kingdom": "k", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / norm)


def digitize(x: Column, edges: Column) -> Column:
    """One more than the number of edges that do not exceed x; repeated edges count."""
    return F.size(F.filter(edges, lambda e: e <= x)) + 1


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def positive_label(label: Column, positive: str) -> Column:
    """1 for the positive label; any other, NULL included, is 0."""
    return F.coalesce(label.cast("string") == positive, F.lit(False)).cast("int")


def parse_lineage(text: Column) -> dict[str, Column]:
    """Ranks of ``k__A|p__B|...``: NULL where a rank is missing, the empty string where it is empty."""
    out = {}
    for rank, letter in RANK_PREFIXES.items():
        pattern = rf"(?:^|\|){letter}__([^|]*)"
        out[rank] = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))
    return out
