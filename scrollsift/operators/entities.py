"""Typed entities of captures: extraction, filters, roll-ups, redaction.

captures: (capture_id, output) at least. Entities: (capture_id, pattern_idx, type, value,
start, end, context, confidence, redact), places in characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry
from scrollsift.operators import graph


def extract(captures: DataFrame, registry: Registry, types: list[str] | None = None, by_tool: bool = False) -> DataFrame:
    """Every match of every pattern, patterns independent of each other, in one pass over the rows.

    types: only these. by_tool: only the types that the capture's tool (column ``tool``)
    hints at, if it has hints.
    """
    output, found = F.col("output"), []
    for i, e in enumerate(registry.entities):
        if types is not None and e.type not in types:
            continue
        spans = T.match_spans(output, e.pattern)
        if by_tool:
            tools = [t.name for t in registry.tools if t.entity_hints and e.type not in t.entity_hints]
            spans = F.when(F.coalesce(F.col("tool").isin(*tools), F.lit(False)), F.array().cast(f"array<{T.SPAN}>")).otherwise(spans)
        found.append(_described(spans, i, e))
    rows = captures.withColumn("_e", F.explode(F.concat(*found)))
    keep = [c for c in captures.columns if c != "output"]
    context = T.context(output, F.col("_e.start"), F.col("_e.end"), F.col("_e.window"))
    return rows.select(*keep, "_e.pattern_idx", "_e.type", "_e.value", "_e.start", "_e.end", context.alias("context"), "_e.confidence", "_e.redact")


def _described(spans, index: int, e):
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(index).alias("pattern_idx"), F.lit(e.type).alias("type"), s.value.alias("value"), s.start.alias("start"), s.end.alias("end"),
            F.lit(e.context_window).alias("window"), F.lit(e.confidence).alias("confidence"), F.lit(e.redact).alias("redact"),
        ),
    )


def of_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.filter(F.col("type") == kind)


def at_least(entities: DataFrame, confidence: float) -> DataFrame:
    return entities.filter(F.col("confidence").cast("float") >= F.lit(confidence).cast("float"))


def sensitive(entities: DataFrame) -> DataFrame:
    return entities.filter("redact")


def types_per_capture(entities: DataFrame) -> DataFrame:
    return entities.groupBy("capture_id").agg(F.array_sort(F.collect_set("type")).alias("types"))


def count_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def recent(entities: DataFrame, n: int = 10) -> DataFrame:
    """The n last entities in order of capture and place."""
    order = [F.desc(c) for c in ("capture_id", "pattern_idx", "start")]
    return entities.orderBy(*order).limit(n)


def redacted_samples(entities: DataFrame, n: int = 3) -> DataFrame:
    """The first n samples of each type, sensitive values hidden."""
    w = W.partitionBy("type").orderBy("capture_id", "start", "pattern_idx")
    shown = F.when(F.col("redact"), F.lit("[REDACTED]")).otherwise(F.col("value"))
    return entities.withColumn("sample", F.row_number().over(w)).filter(F.col("sample") <= n).select("type", "sample", "capture_id", shown.alias("value"))


def capture_metadata(entities: DataFrame) -> DataFrame:
    """Types, count, hosts (repeats kept), vulnerabilities and sensitivity of each capture."""
    place = F.struct("pattern_idx", "start", "value")
    listed = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, place))), lambda x: x.value)
    return entities.groupBy("capture_id").agg(
        F.array_sort(F.collect_set("type")).alias("entity_types"),
        F.count("*").alias("entity_count"),
        listed(F.col("type").isin("ip_address", "hostname")).alias("hosts"),
        listed(F.col("type") == "cve").alias("vulnerabilities"),
        F.bool_or("redact").alias("has_sensitive"),
    )


def metadata_json(metadata: DataFrame) -> DataFrame:
    return metadata.select("capture_id", F.to_json(F.struct(*[c for c in metadata.columns if c != "capture_id"])).alias("metadata"))


METADATA = "entity_types array<string>, entity_count bigint, hosts array<string>, vulnerabilities array<string>, has_sensitive boolean"


def metadata_decoded(rows: DataFrame) -> DataFrame:
    """(..., metadata) -> the metadata's fields beside the others; what can't be decoded gives empty ones."""
    m = F.from_json("metadata", METADATA)
    none = lambda c: F.coalesce(m[c], F.array().cast("array<string>")).alias(c)
    others = [c for c in rows.columns if c != "metadata"]
    return rows.select(
        *others, none("entity_types"), F.coalesce(m["entity_count"], F.lit(0)).alias("entity_count"), none("hosts"), none("vulnerabilities"),
        F.coalesce(m["has_sensitive"], F.lit(False)).alias("has_sensitive"),
    )


def of_capture(entities: DataFrame, capture_id: int) -> DataFrame:
    return entities.filter(F.col("capture_id") == capture_id)


def chunk_metadata(chunks: DataFrame, registry: Registry) -> DataFrame:
    """(id, text) -> (id, entity_count, has_sensitive): what the text of each chunk has."""
    found = extract(chunks.select("id", F.col("text").alias("output")), registry).groupBy("id").agg(F.count("*").alias("entity_count"), F.bool_or("redact").alias("has_sensitive"))
    filled = chunks.select("id").join(found, "id", "left")
    return filled.select("id", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("has_sensitive", F.lit(False)).alias("has_sensitive"))


def enrich(entities: DataFrame, folder: str) -> DataFrame:
    """Add a batch's entities to the stored graph, then give the metadata of its captures."""
    graph.append_edges(entities, folder)
    return capture_metadata(entities)


def with_tool(captures: DataFrame, registry: Registry, command: str = "command") -> DataFrame:
    return captures.withColumn("tool", registry.detect_tool(F.col(command)))


def classified_lines(lines: DataFrame, registry: Registry) -> DataFrame:
    """Output lines of known tools with the sections they belong to (opt-in)."""
    return lines.withColumn("sections", registry.sections(F.col("tool"), F.col("line"))).filter(F.size("sections") > 0)
