"""A seeded synthetic cohort: families, study effects, a disease effect and sparsity.

Draws hash the row's keys, so the tables do not depend on partitioning. The distribution follows the
description of the published generator; values are not bitwise those of another random generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAMILIES = 18
SICK_FAMILIES = 4


def uniform(seed: int, *keys) -> Column:
    """A draw in (0, 1) for each key."""
    h = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def samples(spark: SparkSession, n_studies: int = 3, per_study: int = 120, seed: int = 0) -> DataFrame:
    n = n_studies * per_study
    s = spark.range(n).select("id", F.floor(F.col("id") / per_study).cast("int").alias("study"))
    case = uniform(seed + 10, "id") < 0.45
    return s.select(
        "id",
        "study",
        F.concat(F.lit("Study_"), F.char(F.col("study") + 65)).alias("study_name"),
        F.format_string("Study_%s_S%04d", F.char(F.col("study") + 65), F.pmod("id", F.lit(per_study))).alias("sample_id"),
        F.when(case, "case").otherwise("control").alias("study_condition"),
        F.when(case, "target").otherwise("healthy").alias("disease"),
        (66 + 8 * normal(seed + 20, "id")).cast("int").alias("age"),
        F.when(uniform(seed + 30, "id") < 0.5, "male").otherwise("female").alias("gender"),
    )


def family(seed: int, feature: str | Column = "feature_idx") -> Column:
    """The family that a feature is drawn into."""
    return F.floor(uniform(seed + 35, feature) * FAMILIES).cast("int")


def sick_families(seed: int) -> Column:
    """Four families, drawn without replacement: those with the least draws."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(FAMILIES - 1)), lambda x: F.struct(uniform(seed + 36, x).alias("u"), x.cast("int").alias("f")))
    return F.slice(F.array_sort(drawn), 1, SICK_FAMILIES)["f"]


def taxa(spark: SparkSession, people: DataFrame, n_taxa: int = 180, seed: int = 0) -> DataFrame:
    """Cells with row sum 100: log-normal abundances around family means, study shifts, a shift of some families in cases, 35 % zeros.

    A sample that loses all its cells has one, of a drawn feature.
    """
    f = spark.range(n_taxa).select(F.col("id").cast("int").alias("feature_idx")).withColumn("family", family(seed))
    f = f.withColumn("base", normal(seed + 40, "family") + 0.4 * normal(seed + 42, "feature_idx")).withColumn("sick", F.array_contains(sick_families(seed), F.col("family")))
    shift = 0.6 * normal(seed + 50, "study", "feature_idx")
    effect = F.when(F.col("sick") & (F.col("study_condition") == "case"), 0.9).otherwise(0.0)
    raw = F.exp(F.col("base") + shift + effect + 0.7 * normal(seed + 60, "id", "feature_idx"))
    # every sample meets every feature: the table itself, not a join of two large sides
    grid = people.select("id", "sample_id", "study", "study_condition").join(F.broadcast(f))
    own = Window.partitionBy("sample_id")
    grid = grid.withColumn("raw", F.when(uniform(seed + 70, "id", "feature_idx") > 0.35, raw))
    lone = F.floor(uniform(seed + 75, "id") * n_taxa) == F.col("feature_idx")
    grid = grid.withColumn("raw", F.when((F.count("raw").over(own) == 0) & lone, 1.0).otherwise(F.col("raw"))).where("raw is not null")
    cells = grid.select("sample_id", "feature_idx", F.format_string("s__Species_%03d", "feature_idx").alias("feature"), "raw")
    return cells.withColumn("abundance", 100 * F.col("raw") / F.sum("raw").over(own)).drop("raw")


def pathways(taxa_cells: DataFrame, n_paths: int = 90, seed: int = 0, shared_mix: bool = False, n_taxa: int = 180) -> DataFrame:
    """Cells of a second modality: log abundances of taxa through a sparse normal mixture (5 % of its weights are not zero), study
    shifts and noise; 20 % zeros. Each sample has a mixture of its own, or all share one (``shared_mix``)."""
    key = ["p", "feature_idx"] if shared_mix else ["sample_id", "p", "feature_idx"]
    some = F.filter(F.sequence(F.lit(0), F.lit(n_paths - 1)), lambda p: uniform(seed + 79, *[p if k == "p" else F.col(k) for k in key]) < 0.05)
    # the entry -1 keeps a sample whose weights are all zero
    x = taxa_cells.select("sample_id", "feature_idx", "abundance", F.explode(F.concat(F.array(F.lit(-1)), some)).alias("p"))
    x = x.groupBy("sample_id", "p").agg(F.sum(F.log1p("abundance") * normal(seed + 80, *key)).alias("mixed"))
    x = x.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "mixed"))).alias("m"))
    x = x.select("sample_id", "m", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))).alias("p"))
    study = F.substring_index("sample_id", "_S", 1)
    log = F.coalesce(F.try_element_at("m", F.col("p")), F.lit(0.0)) / F.sqrt(F.lit(float(n_taxa))) + 0.6 * normal(seed + 82, study, "p") + 0.5 * normal(seed + 84, "sample_id", "p")
    own = Window.partitionBy("sample_id")
    x = x.withColumn("raw", F.when(uniform(seed + 90, "sample_id", "p") > 0.2, F.exp(log)))
    lone = F.floor(uniform(seed + 95, "sample_id") * n_paths) == F.col("p")
    x = x.withColumn("raw", F.when((F.count("raw").over(own) == 0) & lone, 1.0).otherwise(F.col("raw"))).where("raw is not null")
    return x.select("sample_id", F.col("p").cast("int").alias("feature_idx"), F.format_string("PWY-%04d", F.col("p")).alias("feature"), (100 * F.col("raw") / F.sum("raw").over(own)).alias("abundance"))


def lineage(spark: SparkSession, n_taxa: int = 180, seed: int = 0) -> DataFrame:
    """Ranks above the family come from the family's number; genera are runs of three taxa, so this is no tree."""
    x = spark.range(n_taxa).select("id", family(seed, F.col("id").cast("int")).alias("f"))
    name = lambda label, n: F.concat(F.lit(f"{label}_"), n.cast("int").cast("string"))
    species = F.format_string("s__Species_%03d", "id")
    return x.select(
        F.lit("Bacteria").alias("kingdom"),
        name("Phylum", F.floor(F.col("f") / 4)).alias("phylum"),
        name("Class", F.floor(F.col("f") / 3)).alias("class"),
        name("Order", F.floor(F.col("f") / 2)).alias("order"),
        F.format_string("Family_%02d", "f").alias("family"),
        F.format_string("Genus_%02d", F.floor(F.col("id") / 3)).alias("genus"),
        species.alias("species"),
        species.alias("taxon"),
        F.col("id").alias("src_row"),
    )
