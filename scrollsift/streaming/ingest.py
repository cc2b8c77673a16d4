"""Streaming ingest: stateful first-tier filter, and a batch writer with a quarantine.

The stateful filter keeps a count for each (session, normalized line), so sessions
spread over all tasks. Its rows equal the batch filter's as long as micro-batches
come in the order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry
from scrollsift.operators import entities as E
from scrollsift.operators import filtering, storage
from scrollsift.sources import captures as C
from scrollsift.sources import tables

KEPT = "session_id string, normalized string, capture_id bigint, ts bigint, line_no int, line string, occurrence int"


class FirstLines(StatefulProcessor):
    """Keeps the first lines of a key; the count is dropped after a time without use."""

    def __init__(self, most: int, ttl_ms: int | None = None):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        if n < self.most:
            order, kept = ["ts", "capture_id", "line_no"], None
            for frame in rows:  # never more than the first few rows and one batch of them are held
                both = frame if kept is None else pd.concat([kept, frame])
                kept = both.sort_values(order, kind="stable").head(self.most - n)
            self.seen.update((n + len(kept),))
            yield kept.assign(occurrence=range(n + 1, n + 1 + len(kept)))[["session_id", "normalized", "capture_id", "ts", "line_no", "line", "occurrence"]].astype({"occurrence": "int32"})

    def close(self) -> None:
        pass


def tier1(captures: DataFrame, registry: Registry, ttl_ms: int | None = None) -> DataFrame:
    """Streaming (capture_id, session_id, ts, output) -> kept lines, append mode."""
    lines = filtering.explode_lines(captures).withColumn("normalized", registry.normalize_tier1(F.col("line")))
    return lines.groupBy("session_id", "normalized").transformWithStateInPandas(FirstLines(registry.tier1.max_occurrences, ttl_ms), KEPT, "append", "processingTime" if ttl_ms else "none")


def state_gauge(spark, checkpoint: str) -> DataFrame:
    """(session_id, forms): keys whose counts the first tier's state holds, by session."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "seen").load()
    return state.groupBy("key.session_id").agg(F.count("*").alias("forms"))


def reset(spark, checkpoint: str) -> bool:
    """Forget all counts: the next start of the filter begins anew. False if there was no state."""
    return tables.delete(spark, checkpoint)


def counted(messages: DataFrame, name: str = "messages") -> DataFrame:
    """Decoded messages that report, with each batch's progress, how many came and how many were unusable."""
    return messages.observe(name, F.count("*").alias("processed"), F.count_if(F.col("reject").isNotNull()).alias("errors"))


def batch_writer(folder: str, registry: Registry):
    """foreachBatch: one set of tables a batch below ``folder``, written parents first.

    A batch overwrites its own folder, so one that is run again after a failure leaves
    no row twice. Messages that can't be used go to the quarantine.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"{folder}/{{}}/batch={batch_id}"
        put = lambda df, name: df.write.mode("overwrite").parquet(at.format(name))
        messages = C.decoded(batch)
        put(C.rejected(messages), "quarantine")
        rows = C.accepted(messages)
        key = F.xxhash64("session_id", "ts", "command", "output")
        put(rows.withColumn("capture_id", key).withColumn("output_hash", T.content_hash(F.col("output"))).withColumn("tool", registry.detect_tool(F.col("command"))), "landed")
        landed = batch.sparkSession.read.parquet(at.format("landed"))
        put(storage.blobs(landed).join(storage.blob_contents(landed), "hash"), "blobs")
        put(landed.drop("output"), "captures")
        put(E.extract(landed.select("capture_id", "output"), registry), "entities")
        clusters = filtering.cluster_metadata(filtering.filter_pipeline(landed.select("capture_id", "session_id", "ts", "output"), registry))
        chunk = F.xxhash64("capture_id", "pattern", "split_no").alias("id")
        put(clusters.join(landed.select("capture_id", F.col("output_hash").alias("blob_hash")), "capture_id").select(chunk, "*"), "chunks")

    return write


def ingest(messages: DataFrame, folder: str, checkpoint: str, registry: Registry, interval: str | None = None):
    """Start the ingest of a message stream; without an interval it takes what is there and ends."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return messages.writeStream.foreachBatch(batch_writer(folder, registry)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
