"""Sample-by-feature tables: wide CSV in and out, long cells inside.

Cells hold what was detected (``sample_id, feature, abundance > 0``); a dimension table keeps all features in header
order, since a feature's place is its token and all-zero features count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rank and metadata columns of the file format.
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")

METADATA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("study_name", T.StringType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("study_condition", T.StringType()),
        T.StructField("disease", T.StringType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("gender", T.StringType()),
        T.StructField("BMI", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("number_reads", T.DoubleType()),
        T.StructField("days_from_first_collection", T.DoubleType()),
    ]
)


def read_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def read_wide(spark: SparkSession, path: str, sample: str = "sample_id", null: str = "NA") -> DataFrame:
    """A wide abundance CSV with an explicit schema: no inference pass, and ``null`` cells are NULL."""
    names = read_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType() if c == sample else T.DoubleType()) for c in names])
    return spark.read.schema(schema).csv(path, header=True, nullValue=null)


def to_cells(wide: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Wide -> long: one row per positive cell. NaN counts as not measured."""
    features = [c for c in wide.columns if c != sample]
    quoted = [f"`{c}`" for c in features]
    long = wide.unpivot([sample], quoted, "feature", "abundance")
    value = F.nanvl(F.col("abundance"), F.lit(None).cast("double"))
    return long.select(F.col(sample).alias("sample_id"), "feature", value.alias("abundance")).where("abundance > 0")


#: A field of a line: quoted, or up to the next comma.
FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _plain(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, 2, F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


def _first(line: Column) -> Column:
    return _plain(F.regexp_extract(line, FIELD, 1))


def _fields(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(FIELD), F.lit(1)), _plain)


#: Stretches of fields that are a mere 0, and what stands for one on the way to Python: a batch of very wide lines is short.
ZEROS, MARK = ",0" * 64, "\u0001"


def _packed(line: Column) -> Column:
    """Lines without the mark in them are shortened; a stretch ends at a comma, so its last field is whole."""
    return F.when(~F.contains(line, F.lit(MARK)), F.replace(line, F.lit(f"{ZEROS},"), F.lit(f"{MARK},"))).otherwise(line)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines -> sample_id, place, field; fields that are a mere 0, nearly all of a wide line, are passed over by comparing bytes."""
    quoted = re.compile(FIELD.encode())
    plain = lambda x: x[1:-1].replace(b'""', b'"') if x.startswith(b'"') else x

    for batch in batches:
        samples, counts, places, fields = [], [], [], []
        for line, packed in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = line.as_buffer()
            if packed:
                data = pa.py_buffer(data.to_pybytes().replace(MARK.encode(), ZEROS.encode()))
            x = np.frombuffer(data, np.uint8)
            if (x == ord('"')).any():
                found = [plain(m.group(1)) for m in quoted.finditer(data.to_pybytes())]
                mine = [k for k in range(1, len(found)) if found[k] != b"0"]
                values = [found[k] for k in mine]
                samples.append(found[0])
            else:
                ends = np.r_[np.flatnonzero(x == ord(",")), len(x)]
                starts = np.r_[0, ends[:-1] + 1]
                alone = ends - starts == 1
                alone[alone] = x[starts[alone]] == ord("0")
                mine = (np.flatnonzero(~alone[1:]) + 1).tolist()
                values = [x[starts[k] : ends[k]].tobytes() for k in mine]
                samples.append(x[: ends[0]].tobytes())
            counts.append(len(mine))
            places += mine
            fields += values
        names = pa.array(samples, pa.binary()).cast(pa.string()).take(pa.array(np.repeat(np.arange(len(samples)), counts)))
        yield pa.RecordBatch.from_arrays([names, pa.array(places, pa.int32()), pa.array(fields, pa.binary()).cast(pa.string())], names=["sample_id", "place", "field"])


def _lines(spark: SparkSession, path: str, sample: str) -> tuple[DataFrame, DataFrame]:
    """Lines that hold samples, and those that are headers."""
    lines = spark.read.text(path).where("value <> ''")
    is_header = _first(F.col("value")) == F.lit(sample)
    return lines.where(~is_header), lines.where(is_header)


def read_wide_samples(spark: SparkSession, path: str, sample: str = "sample_id") -> DataFrame:
    """Samples of a wide CSV, those without any cell too."""
    return _lines(spark, path, sample)[0].select(_first(F.col("value")).alias("sample_id"))


def read_wide_cells(spark: SparkSession, path: str, sample: str = "sample_id", null: str = "NA") -> tuple[DataFrame, DataFrame]:
    """(cells, features) of a wide CSV with any number of columns: lines are cut into fields that meet the header by place.

    No plan grows with the number of features, and the header stays a table. Every file may begin with the header; fields hold no line
    ends. Cells are positive numbers; ``null`` and what is no number is not measured.
    """
    lines, headers = _lines(spark, path, sample)
    header = headers.limit(1).select(F.posexplode(_fields(F.col("value"))).alias("place", "feature"))
    features = header.where("place > 0").select((F.col("place") - 1).alias("feature_idx"), "feature")
    x = lines.select(_packed(F.col("value")).alias("line"), (~F.contains("value", F.lit(MARK))).alias("packed")).mapInArrow(_cut, "sample_id string, place int, field string")
    value = F.when(F.col("field") != null, F.expr("try_cast(field AS double)"))
    cells = x.select("sample_id", (F.col("place") - 1).alias("feature_idx"), F.nanvl(value, F.lit(None).cast("double")).alias("abundance")).where("abundance > 0")
    return cells.join(features, "feature_idx").select("sample_id", "feature", "feature_idx", "abundance"), features


def write_wide_cells(cells: DataFrame, features: DataFrame, path: str, sample: str = "sample_id", samples: DataFrame | None = None) -> None:
    """A wide CSV of (sample, feature_idx, abundance) cells, 0 for what is absent; ``samples`` keeps those without any cell.

    A line is its sample's sorted cells with runs of zeros between them. The header, as long as the dimension, begins every file. Files are
    compressed: samples times features, they are nearly all zeros.
    """
    quoted = lambda x: F.when(F.regexp_like(x, F.lit('[,"]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    named = features.agg(F.array_sort(F.collect_list(F.struct("feature_idx", quoted(F.col("feature")).alias("name")))).alias("h"), F.count("*").alias("n")).first()
    n, header = named.n, ",".join([sample, *(r.name for r in named.h)])
    x = cells.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col("feature_idx").cast("int").alias("i"), F.col("abundance").cast("string").alias("v")))).alias("c"))
    if samples is not None:
        x = samples.select(sample).distinct().join(x, sample, "left")
    c = F.coalesce("c", F.array().cast("array<struct<i:int,v:string>>"))
    before = F.concat(F.array(F.lit(-1)), F.transform(c, lambda e: e["i"]))
    zeros = lambda k: F.repeat(F.lit(",0"), k)
    parts = F.transform(c, lambda e, at: F.concat(zeros(e["i"] - F.get(before, at) - 1), F.lit(","), e["v"]))
    line = F.concat(quoted(F.col(sample).cast("string")), F.array_join(parts, ""), zeros(F.lit(n) - 1 - F.element_at(before, -1)))
    # one column whose name is the header, and no separator that a line could hold
    x.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").option("compression", "gzip").csv(path)


def feature_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "feature_idx int, feature string")


def features_by_name(features: DataFrame) -> DataFrame:
    """Numbers the features of a dimension table in the order of their names; the window runs over the dimension only."""
    from pyspark.sql import Window

    order = Window.orderBy("feature")
    return features.select("feature").distinct().select((F.row_number().over(order) - 1).alias("feature_idx"), "feature")


def to_wide(cells: DataFrame, names: list, sample: str = "sample_id", samples: DataFrame | None = None) -> DataFrame:
    """Long -> wide with 0 for what is absent; ``samples`` keeps those without any cell."""
    wide = cells.groupBy(sample).pivot("feature", names).agg(F.first("abundance"))
    if samples is not None:
        wide = samples.select(sample).join(wide, sample, "left")
    return wide.select(sample, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(str(n)) for n in names])


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist; others are tolerated."""
    return df.select([c for c in wanted if c in df.columns])


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def align(*tables: DataFrame, key: str = "sample_id", ordered: bool = False) -> list[DataFrame]:
    """Restricts every table to the keys that all hold. Semi joins: repeated keys keep their number and do not multiply.

    With ``ordered``, rows come in the order of their keys.
    """
    out = []
    for k, table in enumerate(tables):
        for j, other in enumerate(tables):
            if j != k:
                table = table.join(other.select(key).distinct(), key, "left_semi")
        out.append(table.orderBy(key) if ordered else table)
    return out


def paired_samples(a: DataFrame, b: DataFrame, least: int = 50, key: str = "sample_id") -> DataFrame:
    """Keys of both; fails when read if there are not more than ``least``."""
    common = a.select(key).intersect(b.select(key))
    n = common.agg(F.count("*").alias("n"))
    checked = n.select(F.assert_true(F.col("n") > least, f"needs more than {least} paired samples").isNull().alias("ok"))
    return common.join(F.broadcast(checked.where("ok"))).select(key)


def merge_studies(*studies: DataFrame) -> DataFrame:
    """Cells of several studies; a feature that a study lacks is absent, which means 0."""
    out = studies[0]
    for s in studies[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def matching_files(spark: SparkSession, folder: str, studies: list[str], kind: str) -> DataFrame:
    """Paths of local resources whose name has one of the studies and then the kind."""
    pattern = f"({'|'.join(studies)}).*{kind}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.where(F.col("path").rlike(pattern))


@dataclass
class Cohort:
    taxa: DataFrame
    taxa_features: DataFrame
    metadata: DataFrame
    pathways: DataFrame | None = None
    pathway_features: DataFrame | None = None
    lineage: DataFrame | None = None


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Rank columns and key of each taxon, with ``src_row`` in the order of the file."""
    return spark.read.csv(path, header=True, nullValue="NA").withColumn("src_row", F.monotonically_increasing_id())


def load_cohort(spark: SparkSession, folder: str) -> Cohort:
    """The four CSV files of a cohort, pathway and lineage being optional, restricted to common samples."""
    at = lambda name: f"{folder}/{name}.csv"
    found = ["taxa", *(["pathway"] if _exists(spark, at("pathway_abundance")) else [])]
    # no plan is as wide as a table
    wide = {n: (*read_wide_cells(spark, at(f"{n}_abundance")), read_wide_samples(spark, at(f"{n}_abundance"))) for n in found}
    names = read_header(spark, at("metadata"))
    known = {f.name: f for f in METADATA.fields}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in names])
    meta = spark.read.schema(schema).csv(at("metadata"), header=True, nullValue="NA")
    *kept, meta = align(*[samples for _, _, samples in wide.values()], meta)
    lineage = read_lineage(spark, at("taxa_lineage")) if _exists(spark, at("taxa_lineage")) else None
    cells = [x.join(k.distinct(), "sample_id", "left_semi").select("sample_id", "feature", "abundance") for (x, _, _), k in zip(wide.values(), kept, strict=True)]
    columns = [features for _, features, _ in wide.values()]
    return Cohort(cells[0], columns[0], meta, *((cells[1], columns[1]) if len(cells) > 1 else (None, None)), lineage)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON, a file for each partition that holds any: a report is one, and losses of all batches stay spread."""
    df.write.mode("overwrite").json(path)


def write_cells(cells: DataFrame, path: str, modality: str) -> None:
    """The native sink: long cells as Parquet, partitioned by modality."""
    cells.withColumn("modality", F.lit(modality)).write.mode("append").partitionBy("modality").parquet(path)
