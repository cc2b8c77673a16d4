"""Queries of storage, sessions and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T
from scrollsift.operators import report as R
from scrollsift.operators import sessions as N
from scrollsift.operators import storage as S
from scrollsift.plans import common as C
from scrollsift.sources import tables


def _captures(spark: SparkSession, d: str) -> DataFrame:
    return tables.captures(spark, d)


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).withColumn("output_hash", T.content_hash(F.col("output")))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the captures that have a label: what is still referenced."""
    return _hashed(spark, d).join(tables.read(spark, d, "labels").select(F.col("doc_id").alias("capture_id")), "capture_id").select(F.col("output_hash").alias("hash"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select(F.col("capture_id").alias("id"), "capture_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def blob_dedup_refcount(spark, d):
    return S.blobs(_captures(spark, d)).select("hash", "size", "created_at", "ref_count", "compressed")


def blob_paths(spark, d):
    return S.blob_paths(S.blobs(_captures(spark, d))).select("hash", "path")


def blob_gc(spark, d):
    return S.unreferenced(S.blobs(_captures(spark, d)), _labelled(spark, d)).select("hash", "size")


def blob_gc_stats(spark, d):
    return S.gc_stats(S.blobs(_captures(spark, d)), _labelled(spark, d))


def blob_join(spark, d):
    return S.captures_with_blobs(_hashed(spark, d), S.blobs(_captures(spark, d))).select("capture_id", "hash", "size", "ref_count")


def chunks_without_embeddings(spark, d):
    return S.without_embeddings(_chunks(spark, d), _vectors(spark, d)).select("id")


def embedding_upsert(spark, d):
    stored = _vectors(spark, d).select("chunk_id", "label", F.lit(1).alias("created_at"))
    new = stored.filter(F.col("chunk_id") % 3 == 0).withColumns({"label": F.col("label") + 100, "created_at": F.lit(2)})
    return C.plain(S.upserted(stored, new, "chunk_id").select("chunk_id", "label", "created_at"))


def db_stats(spark, d):
    captures = _captures(spark, d)
    return S.db_stats({"sessions": captures.select("session_id").distinct(), "captures": captures, "blobs": S.blobs(captures), "chunks": _chunks(spark, d), "embeddings": _vectors(spark, d)})


def union_counts(spark, d):
    return R.counts({t: tables.read(spark, d, t) for t in ("documents", "pages", "conversations")})


def referential_check(spark, d):
    return S.orphans(tables.read(spark, d, "embeddings"), "vec_id", tables.read(spark, d, "labels"), "doc_id").select("vec_id")


def cascade_delete(spark, d):
    gone = _captures(spark, d).filter("session_id = 'src1'")
    return S.cascade(tables.read(spark, d, "labels"), "doc_id", gone, "capture_id").select("doc_id")


def session_rollup(spark, d):
    return N.rollup(_captures(spark, d))


def sessions_recent(spark, d):
    return N.newest(N.rollup(_captures(spark, d)))


def session_lifecycle(spark, d):
    """Users as sessions: their events as starts, pauses, resumes and stops."""
    e = tables.read(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("start", "pause", "resume", "stop"))), (F.col("event_id") % 4 + 1).cast("int"))
    one = e.select(F.col("user_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("name"), F.timestamp_seconds("event_id").alias("ts"), kind.alias("event"))
    folded = N.folded(one.withColumn("name", F.concat(F.lit("s"), "session_id")))
    seconds = [F.unix_seconds(c).alias(c) for c in ("started_at", "stopped_at")]
    return folded.select("session_id", "name", *seconds, "status", "status_label")


def capture_point_lookup(spark, d):
    return _captures(spark, d).filter("capture_id = 7").select("capture_id", "session_id")


def chunks_by_ids(spark, d):
    return S.by_ids(_chunks(spark, d), "id", [3, 5, 8, 13, 999_999]).select("id")


def format_size(spark, d):
    return _captures(spark, d).select("capture_id", T.format_size(F.octet_length("output").cast("double") * 777).alias("size"))


def snippet(spark, d):
    return _captures(spark, d).select("capture_id", T.snippet(F.col("output")).alias("snippet"))


INTERVALS = ["500ms", "5s", "7", "1000ms", "x", ""]


def flush_interval(spark, d):
    return spark.createDataFrame([(i,) for i in INTERVALS], "text string").select("text", T.flush_seconds(F.col("text")).alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        blob_dedup_refcount, blob_paths, blob_gc, blob_gc_stats, blob_join, chunks_without_embeddings, embedding_upsert, db_stats, union_counts, referential_check, cascade_delete,
        session_rollup, sessions_recent, session_lifecycle, capture_point_lookup, chunks_by_ids, format_size, snippet, flush_interval,
    )
}

BLOBS = f"WITH {C.CAPTURES}, hashed AS (SELECT *, left(sha256(output), 32) AS hash, strlen(output) AS size FROM caps), blobs AS (SELECT hash, min(size) AS size, min(ts) AS created_at, count(*) AS ref_count, min(size) >= {D.COMPRESS_FROM} AS compressed FROM hashed GROUP BY hash)"
REFS = "refs AS (SELECT DISTINCT hash FROM hashed JOIN labels ON doc_id = capture_id)"
ROLLUP = f"WITH {C.CAPTURES}, r AS (SELECT session_id, count(*) AS capture_count, count(DISTINCT output) AS blob_count, min(ts) AS started_at, max(ts) AS last_at FROM caps GROUP BY session_id)"
_UNITS = [("B", 0), ("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4)]
_SIZE = "CASE " + " ".join(f"WHEN x < {1024 ** (p + 1)} THEN printf('%.2f {u}', x / {1024**p}.0)" for u, p in _UNITS[:-1]) + f" ELSE printf('%.2f TB', x / {1024**4}.0) END"

ORACLES = {
    "blob_dedup_refcount": f"{BLOBS} SELECT * FROM blobs",
    "blob_paths": f"{BLOBS} SELECT hash, hash[1:2] || '/' || hash[3:4] || '/' || hash AS path FROM blobs",
    "blob_gc": f"{BLOBS}, {REFS} SELECT hash, size FROM blobs ANTI JOIN refs USING (hash)",
    "blob_gc_stats": f"{BLOBS}, {REFS} SELECT count(*) AS total, count(*) FILTER (refs.hash IS NULL) AS deleted, CAST(coalesce(sum(size) FILTER (refs.hash IS NULL), 0) AS BIGINT) AS freed_bytes FROM blobs LEFT JOIN refs USING (hash)",
    "blob_join": f"{BLOBS} SELECT capture_id, blobs.hash AS hash, blobs.size AS size, ref_count FROM hashed JOIN blobs USING (hash)",
    "chunks_without_embeddings": "SELECT doc_id AS id FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL",
    "embedding_upsert": "SELECT vec_id AS chunk_id, CAST(CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS BIGINT) AS label, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS created_at FROM embeddings",
    "db_stats": f"{BLOBS} SELECT 'sessions' AS what, count(DISTINCT session_id) AS n FROM caps UNION ALL SELECT 'captures', count(*) FROM caps UNION ALL SELECT 'blobs', count(*) FROM blobs UNION ALL SELECT 'chunks', count(*) FROM caps UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'blob_bytes', CAST(sum(size) AS BIGINT) FROM blobs",
    "union_counts": " UNION ALL ".join(f"SELECT '{t}' AS what, count(*) AS n FROM {t}" for t in ("documents", "pages", "conversations")),
    "referential_check": "SELECT vec_id FROM embeddings ANTI JOIN labels ON vec_id = doc_id",
    "cascade_delete": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')",
    "session_rollup": f"{ROLLUP} SELECT * FROM r",
    "sessions_recent": f"{ROLLUP} SELECT * FROM r ORDER BY started_at DESC, session_id LIMIT 5",
    "session_lifecycle": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ts, ['start', 'pause', 'resume', 'stop'][event_id % 4 + 1] AS event FROM events),
f AS (SELECT session_id, min(ts) AS started_at, max(ts) FILTER (event = 'stop') AS stopped_at, first(event ORDER BY ts DESC) AS last FROM e GROUP BY session_id)
SELECT session_id, 's' || session_id AS name, started_at, stopped_at, CASE last WHEN 'stop' THEN 'stopped' WHEN 'pause' THEN 'paused' ELSE 'active' END AS status, CASE last WHEN 'stop' THEN 'Stopped' WHEN 'pause' THEN 'Paused' ELSE 'Active' END AS status_label FROM f""",
    "capture_point_lookup": "SELECT doc_id AS capture_id, source AS session_id FROM documents WHERE doc_id = 7",
    "chunks_by_ids": "SELECT doc_id AS id FROM documents WHERE doc_id IN (3, 5, 8, 13, 999999)",
    "format_size": f"SELECT doc_id AS capture_id, {_SIZE} AS size FROM (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS DOUBLE) * 777 AS x FROM documents)",
    "snippet": f"WITH {C.CAPTURES} SELECT capture_id, CASE WHEN length(output) <= 200 THEN output ELSE left(output, 200) || '...' END AS snippet FROM caps",
    "flush_interval": "WITH i(text) AS (VALUES " + ", ".join(f"('{i}')" for i in INTERVALS) + ") SELECT text, CASE WHEN regexp_full_match(text, '\\d+ms') THEN CAST(regexp_extract(text, '\\d+') AS DOUBLE) / 1000 WHEN regexp_full_match(text, '\\d+s?') THEN CAST(regexp_extract(text, '\\d+') AS DOUBLE) ELSE 5.0 END AS seconds FROM i",
}
