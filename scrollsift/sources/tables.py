"""Views of the engine's tables over Parquet folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of an input that has fewer splits than there are cores.

    Only an input of a few splits is shuffled by this; a large one has splits enough
    and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as captures: (capture_id, session_id, ts, output)."""
    return spread(read(spark, folder, "documents")).select(
        F.col("doc_id").alias("capture_id"), F.col("source").alias("session_id"), F.col("doc_id").alias("ts"), F.coalesce("text", F.lit("")).alias("output")
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as sessions whose turns are captures."""
    return spread(read(spark, folder, "conversations")).select(
        F.col("turn").alias("capture_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts"), F.coalesce("text", F.lit("")).alias("output")
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='scrollsift-')).rstrip('/')}/scrollsift-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it is; false if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
