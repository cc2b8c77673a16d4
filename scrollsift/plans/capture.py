"""Queries of messages, ingest, sessions and what is stored of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry
from scrollsift.operators import filtering as L
from scrollsift.operators import report as R
from scrollsift.operators import sessions as N
from scrollsift.operators import storage as S
from scrollsift.plans import common as C
from scrollsift.plans import entity, filters, search
from scrollsift.sources import captures as M
from scrollsift.sources import tables
from scrollsift.streaming import ingest

REGISTRY = Registry()
#: Longest message that the decoding query takes.
MOST_BYTES = 150


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Order captures as JSON messages; every 10th is cut short, every 11th has no type."""
    fields = F.struct(
        F.when(F.col("capture_id") % 11 != 0, F.lit("capture")).alias("type"), "session_id", F.col("ts").alias("timestamp"), "command", "output", (F.col("capture_id") % 3).cast("int").alias("exit_code"), F.lit("/").alias("cwd")
    )
    value = F.to_json(fields)
    return C.order_captures(spark, d).select("capture_id", F.when(F.col("capture_id") % 10 == 0, F.left(value, F.lit(20))).otherwise(value).alias("value"))


def message_decode(spark, d):
    rows = M.decoded(_messages(spark, d).select("value"), MOST_BYTES)
    return rows.groupBy("reject").agg(F.count("*").alias("n"), F.count("type").alias("typed"))


def message_accepted(spark, d):
    rows = M.accepted(M.decoded(_messages(spark, d).select("value")))
    return C.plain(rows.select("session_id", F.unix_seconds("ts").alias("ts"), "command", "output", "exit_code", "cwd"))


def message_rejected(spark, d):
    return M.rejected(M.decoded(_messages(spark, d).select("value"), MOST_BYTES))


def response_encode(spark, d):
    rows = tables.read(spark, d, "nation").select(
        (F.col("n_nationkey") % 2 == 0).alias("success"), F.col("n_name").alias("message"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).alias("data")
    )
    return M.responses(rows)


def hook_records(spark, d):
    """Shell records that a hook would land: neither empty nor the engine's own."""
    return M.recorded(C.order_captures(spark, d)).select("capture_id", "command")


def _ingested(spark: SparkSession, d: str) -> str:
    """Order messages put through the ingest stream once; later queries read its tables."""

    def run(folder):
        _messages(spark, d).select("value").write.text(f"{folder}/landing")
        ingest.ingest(M.landing(spark, f"{folder}/landing"), f"{folder}/out", f"{folder}/state", REGISTRY).awaitTermination()
        return f"{folder}/out"

    return search._once(spark, d, "ingested", run)


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{_ingested(spark, d)}/{name}")


def ingest_captures(spark, d):
    return C.plain(_table(spark, d, "captures").select("session_id", F.unix_seconds("ts").alias("ts"), "command", "output_hash", "tool", "exit_code", "cwd"))


def ingest_blobs(spark, d):
    return _table(spark, d, "blobs").select("hash", "content", "size", "ref_count", "compressed")


def ingest_quarantine(spark, d):
    return _table(spark, d, "quarantine").select("value", "reject")


def ingest_entities(spark, d):
    return _table(spark, d, "entities").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def ingest_chunks(spark, d):
    chunks, captures = _table(spark, d, "chunks"), _table(spark, d, "captures")
    rows = chunks.join(captures.select("capture_id", "session_id", F.unix_seconds("ts").alias("ts"), "output_hash"), ["capture_id", "session_id"])
    same = F.col("blob_hash") == F.col("output_hash")
    return rows.groupBy("session_id", "ts").agg(F.count("*").alias("chunks"), F.sum("size").alias("lines"), F.count_distinct("id").alias("ids"), F.bool_and(same).alias("of_blob"))


def cluster_metadata(spark, d):
    """Metadata of coarse clusters, read back from its JSON."""
    clusters = L.cluster_metadata(L.tier3(filters._lines(spark, d), filters._coarse("first")))
    part = lambda name: F.get_json_object("metadata", f"$.{name}")
    return clusters.select("session_id", "capture_id", "split_no", part("pattern").alias("pattern"), part("count").cast("long").alias("n"), part("first_seen").cast("long").alias("first_seen"), part("kind").alias("kind"))


def session_by_name(spark, d):
    named = N.rollup(tables.captures(spark, d)).withColumn("name", F.concat(F.lit("of "), F.col("session_id")))
    return N.by_name(named, "of src3").select("session_id", "name", "capture_count")


def session_durations(spark, d):
    rows = N.rollup(tables.captures(spark, d)).withColumn("stopped_at", F.when(F.col("session_id") != "src2", F.col("last_at")))
    return N.durations(rows, 1_000_000).select("session_id", "duration")


def session_name(spark, d):
    return tables.read(spark, d, "events").select("event_id", T.session_name(F.timestamp_seconds("event_id")).alias("name"))


def preview(spark, d):
    return tables.captures(spark, d).select("capture_id", T.preview(F.col("output"), 40).alias("preview"))


def blob_contents(spark, d):
    return S.blob_contents(tables.captures(spark, d))


def blob_by_hash(spark, d):
    one = T.content_hash(F.lit("done")).alias("hash")
    outputs = C.order_captures(spark, d).select(F.element_at(F.split("output", "\n"), -1).alias("output"))
    digest = spark.range(1).select(one).first()[0]
    return S.content_of(S.blob_contents(outputs), digest)


def blob_exists(spark, d):
    """Whether the blobs of every captured text of the conversations are among those of the documents."""
    asked = tables.turns(spark, d).select(T.content_hash(F.col("output")).alias("hash")).unionByName(tables.captures(spark, d).filter("capture_id < 20").select(T.content_hash(F.col("output")).alias("hash")))
    return S.has_blob(S.blobs(tables.captures(spark, d)), asked)


def blob_delete(spark, d):
    blobs = S.blobs(tables.captures(spark, d))
    return S.without_blobs(blobs, blobs.filter("size % 2 = 0")).select("hash", "size")


def blob_merge(spark, d):
    """Blobs of two batches of captures put together."""
    captures = tables.captures(spark, d)
    both = S.merged_blobs(S.blobs(captures.filter("capture_id % 2 = 0")), S.blobs(captures.filter("capture_id % 2 = 1")))
    return both.select("hash", "size", "created_at", "ref_count", "compressed")


def embedding_by_chunk(spark, d):
    rows = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return C.plain(S.embedding_of(rows, 7))


def vector_dimension(spark, d):
    """Vectors that an index of the others' dimension can't take: every 10th is cut short."""
    from scrollsift.operators import index as I

    rows = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"), F.size("embedding").alias("n"))
    return C.plain(I.dimension_errors(rows.select("id", "vector"), rows.select("n").first()[0]))


def session_delete(spark, d):
    """What stays of captures, and of what hangs on them, when a session goes."""
    captures = C.order_captures(spark, d)
    gone = captures.filter("session_id = 's3'")
    return S.cascade(captures.select("capture_id", "session_id"), "session_id", gone.select("session_id").distinct(), "session_id")


def schema_version(spark, d):
    S.migrate(spark, "scrollsift_check", tables.shared_folder(spark, "database"))
    return spark.table("scrollsift_check.migrations").agg(F.max("version").cast("long").alias("version"))


def export_rows(spark, d):
    return R.export({t: tables.read(spark, d, t) for t in ("documents", "labels", "nation")}, tables.shared_folder(spark, "export")).select("name", "rows")


def zone_bytes(spark, d):
    """Bytes of the files below a folder."""
    folder = tables.shared_folder(spark, "zones")
    rows = tables.read(spark, d, "nation").select(F.col("n_name").alias("value"))
    rows.write.text(f"{folder}/names")
    return S.zone_sizes(spark, {"names": f"{folder}/names/*.txt"})


def state_gauge(spark, d):
    """Forms that the stateful first tier counts, by session, after the conversations' turns."""
    return ingest.state_gauge(spark, f"{search.streamed(spark, d)}/state")


QUERIES = {
    f.__name__: f
    for f in (
        message_decode, message_accepted, message_rejected, response_encode, hook_records, ingest_captures, ingest_blobs, ingest_quarantine, ingest_entities, ingest_chunks, cluster_metadata,
        session_by_name, session_durations, session_name, preview, blob_contents, blob_by_hash, blob_exists, blob_delete, blob_merge, embedding_by_chunk, vector_dimension, session_delete,
        schema_version, export_rows, zone_bytes, state_gauge,
    )
}

#: The messages' JSON, as the encoder writes it.
_QUOTED = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
_VALUE = (
    "'{' || CASE WHEN capture_id % 11 <> 0 THEN '\"type\":\"capture\",' ELSE '' END || '\"session_id\":\"' || session_id || '\",\"timestamp\":' || ts || ',\"command\":\"' || command || '\",\"output\":\"' || "
    + _QUOTED.format("output")
    + " || '\",\"exit_code\":' || (capture_id % 3) || ',\"cwd\":\"/\"}'"
)
MESSAGES = f"WITH {C.ORDER_CAPTURES}, v AS (SELECT *, {_VALUE} AS whole FROM caps), m AS (SELECT *, CASE WHEN capture_id % 10 = 0 THEN left(whole, 20) ELSE whole END AS value FROM v)"
_GOOD = "capture_id % 10 <> 0 AND capture_id % 11 <> 0"
_REJECT = f"CASE WHEN strlen(value) > {{}} THEN 'oversize' WHEN NOT ({_GOOD}) THEN 'malformed' END"
#: The captures that the ingest lands, as (session_id, capture_id, ts, output).
LANDED = f"WITH {C.ORDER_CAPTURES.replace('caps AS', 'every AS')}, caps AS (SELECT * FROM every WHERE {_GOOD})"
_HASH = "left(sha256({}), 32)"

ORACLES = {
    "message_decode": f"{MESSAGES}, r AS (SELECT {_REJECT.format(MOST_BYTES)} AS reject, CASE WHEN {_GOOD} THEN 1 END AS t FROM m) SELECT reject, count(*) AS n, count(t) AS typed FROM r GROUP BY reject",
    "message_accepted": f"{MESSAGES} SELECT session_id, ts, command, output, capture_id % 3 AS exit_code, '/' AS cwd FROM m WHERE {_GOOD}",
    "message_rejected": f"{MESSAGES}, r AS (SELECT value, {_REJECT.format(MOST_BYTES)} AS reject FROM m) SELECT * FROM r WHERE reject IS NOT NULL",
    "response_encode": "SELECT '{\"success\":' || (n_nationkey % 2 = 0) || ',\"message\":\"' || n_name || '\"' || CASE WHEN n_nationkey % 3 = 0 THEN ',\"data\":\"' || n_nationkey || '\"' ELSE '' END || '}' AS value FROM nation",
    "hook_records": f"WITH {C.ORDER_CAPTURES} SELECT capture_id, command FROM caps WHERE trim(command) <> '' AND NOT regexp_matches(command, '^\\s*scrollsift\\b')",
    "ingest_captures": f"{LANDED} SELECT session_id, ts, command, {_HASH.format('output')} AS output_hash, {entity._TOOL} AS tool, capture_id % 3 AS exit_code, '/' AS cwd FROM caps",
    "ingest_blobs": f"{LANDED} SELECT {_HASH.format('output')} AS hash, output AS content, strlen(output) AS size, count(*) AS ref_count, strlen(output) >= {D.COMPRESS_FROM} AS compressed FROM caps GROUP BY output",
    "ingest_quarantine": f"{MESSAGES} SELECT value, 'malformed' AS reject FROM m WHERE NOT ({_GOOD})",
    "ingest_entities": f"{LANDED}, {entity._matches('caps')} SELECT type, count(*) AS n, count(DISTINCT value) AS n_values FROM found GROUP BY type",
    "ingest_chunks": f"""{LANDED}, {C.LINES}, {C.FORMS}, {C.SCORES}, {C.clusters_sql("kept2", C.TIER3_RULES, D.CLUSTER_MIN, D.CLUSTER_MAX, C.ORDER[D.STRATEGY])}
SELECT session_id, capture_id AS ts, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS lines, count(*) AS ids, true AS of_blob FROM clusters GROUP BY ALL""",
    "cluster_metadata": f"{filters.BASE}, {C.clusters_sql('lines', filters.COARSE, filters.COARSE_MIN, filters.COARSE_MAX, C.ORDER['first'])} SELECT session_id, capture_id, split_no, pattern, size AS n, first_seen, kind FROM clusters",
    "session_by_name": "SELECT source AS session_id, 'of ' || source AS name, count(*) AS capture_count FROM documents WHERE source = 'src3' GROUP BY source",
    "session_durations": "SELECT source AS session_id, CASE WHEN source = 'src2' THEN 1000000 ELSE max(doc_id) END - min(doc_id) AS duration FROM documents GROUP BY source",
    "session_name": "SELECT event_id, 'session_' || strftime(make_timestamp(CAST(event_id AS BIGINT) * 1000000), '%Y%m%d_%H%M%S') AS name FROM events",
    "preview": f"WITH {C.CAPTURES} SELECT capture_id, CASE WHEN length(output) <= 40 THEN output ELSE left(output, 40) || '...' END AS preview FROM caps",
    "blob_contents": f"WITH {C.CAPTURES} SELECT DISTINCT {_HASH.format('output')} AS hash, output AS content FROM caps",
    "blob_by_hash": f"SELECT {_HASH.format(C.quoted('done'))} AS hash, 'done' AS content",
    "blob_exists": f"""WITH {C.CAPTURES}, asked AS (SELECT {_HASH.format("coalesce(text, '')")} AS hash FROM conversations UNION SELECT {_HASH.format('output')} FROM caps WHERE capture_id < 20)
SELECT hash, hash IN (SELECT {_HASH.format('output')} FROM caps) AS present FROM asked""",
    "blob_delete": f"WITH {C.CAPTURES} SELECT {_HASH.format('output')} AS hash, strlen(output) AS size FROM caps WHERE strlen(output) % 2 = 1 GROUP BY output",
    "blob_merge": f"WITH {C.CAPTURES} SELECT {_HASH.format('output')} AS hash, strlen(output) AS size, min(ts) AS created_at, count(*) AS ref_count, strlen(output) >= {D.COMPRESS_FROM} AS compressed FROM caps GROUP BY output",
    "embedding_by_chunk": "SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id = 7",
    "vector_dimension": "SELECT vec_id AS id, CAST(3 AS BIGINT) AS dimension FROM embeddings WHERE vec_id % 10 = 0",
    "session_delete": f"WITH {C.ORDER_CAPTURES} SELECT capture_id, session_id FROM caps WHERE session_id <> 's3'",
    "schema_version": f"SELECT CAST({S.VERSION} AS BIGINT) AS version",
    "export_rows": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("documents", "labels", "nation")),
    "zone_bytes": "SELECT 'names' AS zone, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation",
    "state_gauge": f"WITH {filters.TURNS}, {C.LINES}, {C.FORMS} SELECT session_id, count(DISTINCT normalized) AS forms FROM forms GROUP BY session_id",
}
