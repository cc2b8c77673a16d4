"""Report and export views over the entities of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.operators import entities as E
from scrollsift.operators import graph as G


def hosts(entities: DataFrame) -> DataFrame:
    return G.host_nodes(entities).select("host", F.size("ports").alias("n_ports"), F.size("vulnerabilities").alias("n_vulnerabilities"), "credentials", "first_seen", "last_seen")


def findings(entities: DataFrame) -> DataFrame:
    return G.host_vulnerabilities(entities).groupBy("cve").agg(F.array_sort(F.collect_set("host")).alias("hosts"), F.min("ts").alias("first_seen"))


def credentials(entities: DataFrame) -> DataFrame:
    """Sensitive entities, values hidden, with how often each type occurs."""
    return E.sensitive(entities).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("capture_id").alias("n_captures"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        row = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def layout(spark: SparkSession, folder: str, session: str) -> dict[str, str]:
    """Folders of a session's report, made if they are missing."""
    at = {part: f"{folder}/reports/{session}/{part}" for part in ("evidence", "export")}
    for path in at.values():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return at


def export(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write tables as Parquet; returns (name, rows, checksum), the checksum free of row order."""
    out = None
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
        back = t.sparkSession.read.parquet(f"{folder}/{name}")
        row = back.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*back.columns)).alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out
