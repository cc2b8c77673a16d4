"""Relational side of the captures: blobs, chunks, embeddings, integrity and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T

SCHEMAS = {
    "sessions": "id string, name string, started_at timestamp, stopped_at timestamp, status string, capture_count bigint, blob_count bigint",
    "captures": "id bigint, session_id string, timestamp timestamp, command string, output_hash string, tool string, exit_code int, cwd string",
    "blobs": "hash string, size bigint, created_at timestamp, compressed boolean, ref_count bigint, content string",
    "chunks": "id bigint, capture_id bigint, blob_hash string, representative_text string, cluster_size bigint, metadata string",
    "embeddings": "chunk_id bigint, vector array<float>, model string, created_at timestamp",
    "entities": "capture_id bigint, type string, value string, context string, confidence double",
}
VERSION = 1


def migrate(spark, database: str = "scrollsift", location: str | None = None) -> int:
    """Create what is missing and record the schema version; returns the version before.

    location: where a new database keeps its tables, if not in the warehouse.
    """
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.migrations (version int, applied_at timestamp) USING parquet")
    before = spark.table(f"{database}.migrations").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    if before < VERSION:
        for name, schema in SCHEMAS.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
        spark.sql(f"INSERT INTO {database}.migrations VALUES ({VERSION}, current_timestamp())")
    return before


def blobs(captures: DataFrame, compress_from: int = D.COMPRESS_FROM) -> DataFrame:
    """Content-addressed outputs: one row for each content, however often it was captured."""
    size = F.octet_length("output").cast("long")
    hashed = captures.select(T.content_hash(F.col("output")).alias("hash"), size.alias("size"), F.col("ts").alias("at"))
    return hashed.groupBy("hash").agg(F.min("size").alias("size"), F.min("at").alias("created_at"), F.count("*").alias("ref_count")).withColumn("compressed", F.col("size") >= compress_from)


def blob_contents(captures: DataFrame) -> DataFrame:
    """(hash, content): each distinct output once; Parquet compresses it."""
    rows = captures.select(T.content_hash(F.col("output")).alias("hash"), F.col("output").alias("content"))
    return rows.groupBy("hash").agg(F.first("content").alias("content"))


def content_of(contents: DataFrame, digest: str) -> DataFrame:
    return contents.filter(F.col("hash") == digest)


def has_blob(blobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, present) for each hash asked for."""
    known = blobs.select("hash").distinct().withColumn("present", F.lit(True))
    return hashes.select("hash").distinct().join(known, "hash", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def without_blobs(blobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Blobs that stay when these are deleted."""
    return blobs.join(hashes.select("hash"), "hash", "left_anti")


def merged_blobs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Reference counts of stored and new blobs together."""
    return stored.unionByName(new).groupBy("hash").agg(F.min("size").alias("size"), F.min("created_at").alias("created_at"), F.sum("ref_count").alias("ref_count"), F.bool_or("compressed").alias("compressed"))


def blob_paths(blobs: DataFrame) -> DataFrame:
    return blobs.withColumn("path", T.shard_path(F.col("hash")))


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs that no hash in ``references`` names."""
    return blobs.join(references.select("hash"), "hash", "left_anti")


def gc_stats(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """One row: blobs in all, those that collection would delete and the bytes it would free."""
    named = references.select("hash").distinct().withColumn("_used", F.lit(True))
    gone = F.col("_used").isNull()
    return blobs.join(named, "hash", "left").agg(
        F.count("*").alias("total"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("freed_bytes")
    )


def captures_with_blobs(captures: DataFrame, blobs: DataFrame) -> DataFrame:
    return captures.join(blobs, captures.output_hash == blobs.hash)


def without_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings, chunks.id == embeddings.chunk_id, "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """Latest row of each key; of rows that are equally late, the new one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def by_ids(table: DataFrame, key: str, ids: list[int]) -> DataFrame:
    return table.filter(F.col(key).isin(ids)) if ids else table.limit(0)


def embedding_of(embeddings: DataFrame, chunk_id: int) -> DataFrame:
    """The embedding of a chunk: no row or one."""
    return embeddings.filter(F.col("chunk_id") == chunk_id).limit(1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent is missing; null keys refer to nothing."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def cascade(child: DataFrame, key: str, removed: DataFrame, removed_key: str) -> DataFrame:
    """Rows that stay when their parents are removed."""
    return child.join(removed.select(F.col(removed_key).alias(key)), key, "left_anti")


def db_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table and the bytes of the blobs."""
    counted = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, t in tables.items()]
    counted.append(tables["blobs"].agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).select(F.lit("blob_bytes").alias("what"), "n"))
    return reduce(DataFrame.unionByName, counted)


def zone_sizes(spark, zones: dict[str, str]) -> DataFrame:
    """Bytes of the files below each folder; contents aren't read."""
    read = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
    sizes = [read(p).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(z).alias("zone"), "bytes") for z, p in zones.items()]
    return reduce(DataFrame.unionByName, sizes)
