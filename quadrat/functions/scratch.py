"""Tables that several passes read: written once, so that their lineage runs once and a lost executor costs no upstream work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def fresh(spark: SparkSession) -> str:
    """An unused path in ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    return f"{base.rstrip('/')}/quadrat-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    spark, path = df.sparkSession, fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
