"""Helpers that the operators of this subpackage share: scratch tables, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_local_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (as in tests) gets a temporary folder; a cluster gets an
    error, because its machines could not read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local_scratch[0]


class Scratch:
    """Intermediate tables in the shared folder, so that a lost executor costs no upstream work.

    Tables are Parquet files under a fresh name; ``drop`` removes those no longer needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quadrat-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


#: Rows of an Arrow batch where whole texts go to Python: Spark's own 10,000 would make a batch of long texts hundreds of MB.
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's rows of an Arrow batch to ``TEXT_ROWS``, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node it can reach.

    Alternating large-star and small-star steps; each is one shuffle of the edges with map-side
    minima, and the number of rounds grows with the logarithm of the longest chain. Each round is
    written to the shared folder, so lineage stays short. Nothing is collected but a row count and
    a checksum per round.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e, f"{tag}-0")
    before, k = None, 0
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        k += 1
        e = scratch.save(small.where("u <> v").distinct(), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    roots = stars.select(F.col("comp").alias("node"), "comp").distinct()
    return spark.createDataFrame([], stars.schema).union(stars).union(roots)
