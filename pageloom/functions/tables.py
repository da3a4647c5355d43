"""Tables that later steps of a job read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a new folder where a local run has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-pageloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialised(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once to the shared folder, in a folder for each value of by if given, and read back, so that what uses it starts from a table that survives lost executors and not from its long plan. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove a path when the driver's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
