"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

Terms are words (A-Z in lower case) weighted by 1 + ln(count); the weights vote on the
bits of the terms' hashes. ``near`` finds through tables of permuted blocks what lies
within a Hamming radius of each fingerprint: how many rows do, and the class of all
that are connected by such links. ``with_next`` puts each document beside the next one
by doc_id in one shuffle of the texts.

Null texts count as empty and have fingerprint zero, which links like any other. Equal
texts have equal fingerprints. Rows are ordered by doc_id, nulls first, then by the
XXH64 of the text; equal rows in any order. Very long texts are hashed in blocks.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import documents, named, packed, slices, text_or_empty, written
from scrollsift.llm.components import labelled
from scrollsift.llm.hamming import block_masks, hamming_counts, hamming_links, kept_blocks
from scrollsift.llm.hashing import NON_BLANK, word_hashes

RADIUS = 3
#: Bytes of text that one partition of ``with_next`` is meant to hold.
PARTITION_BYTES = 48 << 20


def fingerprints_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of packed texts."""
    h, first = word_hashes(data, off, NON_BLANK)
    out = np.zeros(len(off) - 1, np.uint64)
    for i in np.flatnonzero(np.diff(first)):
        terms, count = np.unique(h[first[i] : first[i + 1]], return_counts=True)
        weight = 1 + np.log(count).astype(np.float32)
        votes = np.zeros(64, np.float64)
        for s in range(0, len(terms), 1 << 14):
            bits = np.unpackbits(terms[s : s + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += weight[s : s + (1 << 14)] @ bits.astype(np.float32)
        out[i] = np.packbits(votes * 2 > weight.sum(dtype=np.float64), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(*packed(part)).view(np.int64))], names=["doc_id", "fp"])

    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def near(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) -> (fp, class_id, n_near) of each distinct fingerprint.

    n_near: the other rows whose fingerprints lie within the radius, equal ones included.
    class_id: the smallest doc_id that is connected by such links, over any number of
    them; null if no row of the class has a doc_id.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    masks = block_masks(radius, kept_blocks(radius, distinct.count()))
    classes = labelled(distinct.select("fp", "least"), hamming_links(distinct, radius, masks))
    counts = hamming_counts(distinct, radius, masks)
    n_near = F.col("n") - 1 + F.coalesce("near", F.lit(0))
    return distinct.join(classes, "fp").join(counts, "fp", "left").select("fp", F.col("component_id").alias("class_id"), n_near.alias("n_near"))


Make = Callable[..., pa.RecordBatch]


def with_next(docs: DataFrame, make: Make, schema: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Run ``make(ids, fps, texts, next_fps, next_texts)`` over all documents and the ones after them.

    Texts are dealt once, by ranges of Spark's own, and hot doc_ids are split. Within a
    partition rows stand in order, and only a document and the next one are looked at
    together. The first and last rows of the partitions are written beside the results and
    meet afterwards: two texts a partition. The document after the last is the first.
    """
    docs = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    ends = "place int, at_end boolean, end_id long, end_fp long, end_text string"
    names = [*columns, *(c.split(" ")[0] for c in ends.split(", "))]

    def padded(rows: list, found: pa.RecordBatch | None) -> pa.RecordBatch:
        """Results without ends, then ends without results."""
        n = found.num_rows if found is not None else 0
        left = [pa.concat_arrays([found.column(c), pa.nulls(len(rows), found.column(c).type)]) if n else None for c in columns]
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        right = [pa.concat_arrays([pa.nulls(n, k), pa.array([r[i] for r in rows], k)]) for i, k in enumerate(kinds)]
        arrays = [*(x if x is not None else pa.nulls(len(rows), t) for x, t in zip(left, types, strict=True)), *right]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    types = [_ARROW[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before = TaskContext.get().partitionId(), None
        for batch in batches:
            for part in slices(batch, 2 << 20):
                rows = list(zip(part.column("doc_id").to_pylist(), fingerprints_of(*packed(part)).view(np.int64).tolist(), part.column("text").to_pylist(), strict=True))
                first = [(place, False, *rows[0])] if before is None else []
                rows = rows if before is None else [before, *rows]
                before = rows[-1]
                pairs = [(*a, b[1], b[2]) for a, b in zip(rows, rows[1:], strict=False)]
                if first or pairs:
                    yield padded(first, make(*zip(*pairs, strict=True)) if pairs else None)
        if before is not None:
            yield padded([(place, True, *before)], None)

    order = [F.asc_nulls_first("doc_id"), "hash", "row"]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = placed.repartitionByRange(width, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = written(dealt.mapInArrow(run, f"{schema}, {ends}"), "beside_next")
    edges = found.filter("place is not null").select("place", "at_end", F.col("end_id").alias("doc_id"), F.col("end_fp").alias("fp"), F.col("end_text").alias("text"))
    places = sorted(r[0] for r in edges.filter("not at_end").select("place").collect())  # as many as partitions
    turns = docs.sparkSession.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, after int")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(*(c.to_pylist() for c in batch.columns))

    last = edges.filter("at_end").select("place", "doc_id", "fp", "text").join(turns, "place")
    head = edges.filter("not at_end").select(F.col("place").alias("after"), F.col("fp").alias("next_fp"), F.col("text").alias("next_text"))
    met = last.join(head, "after").select("doc_id", "fp", "text", "next_fp", "next_text").mapInArrow(meet, schema)
    return found.filter("place is null").select(*columns).unionByName(met)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / 64


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def _edited(ids, fps, texts, next_fps, next_texts) -> pa.RecordBatch:
    """Each text beside its edited text: the second half replaced by the start of the next text."""
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, next_texts, strict=True)]
    raw = [e.encode("utf-8", "surrogatepass") for e in edited]
    off = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    new = fingerprints_of(np.frombuffer(b"".join(raw), np.uint8), off)
    own, after = (np.array(x, np.int64).view(np.uint64) for x in (fps, next_fps))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
            pa.array(own.view(np.int64)),
            pa.array(new.view(np.int64)),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, after)),
        ],
        names=[c.split(" ")[0] for c in SCHEMA.split(", ")],
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints beside the edited and the next document's, and what is near them."""
    rows = with_next(documents(spark, sf_dir), _edited, SCHEMA)
    found = rows.join(near(rows.select("doc_id", "fp")), "fp")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return found.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "n_near")
