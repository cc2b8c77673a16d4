"""Near-duplicate documents: SimHash fingerprints and covering locality-sensitive hashing.

Nulls count as empty texts; an empty text has fingerprint zero and links like any
other. Rows without doc_id link like others, but a null doc_id never becomes a
component's id: a component without any doc_id has a null one. Rows that share a
doc_id are one document: ``near_duplicates`` links their fingerprints, so their
component is one, whatever their texts. Repeated rows give repeated rows. Very long
texts are taken whole, a text at a time. Extra columns are ignored or stay, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.llm.common import documents, named, numbered, written
from scrollsift.llm.components import labelled
from scrollsift.llm.hamming import covering_masks, hamming_links

SEED = 42
SHINGLE = 4
RADIUS = 4


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words of the text in lower case (A-Z only)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: splits at \x20 and \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    pairs = zip(start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], seed) for s, e in pairs], np.uint64)


def majority(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """Fingerprint whose bits are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str) -> int:
    return majority(shingle_hashes(text))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        prints = np.fromiter((simhash(t.as_py() or "") for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(prints.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): one row per document."""
    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _labels(prints: DataFrame, radius: int, by_id: bool) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints: the least fingerprint and the smallest doc_id of their component.

    Copies are collapsed to one row per distinct fingerprint before any search, with
    or without a doc_id. ``by_id`` links the fingerprints of a doc_id too.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = hamming_links(distinct, radius, covering_masks(radius))
    if by_id:
        firsts = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("last"))
        several = firsts.filter("b < last").select("doc_id", "b")
        links = links.unionByName(prints.join(several, "doc_id").select(F.col("fp").alias("a"), "b"))
    return labelled(distinct, links)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are connected by
    links of at most ``radius`` differing bits share the smallest doc_id among them.
    """
    prints = written(fingerprints(docs), "prints")
    return prints.join(_labels(prints, radius, True), "fp").select("doc_id", "fp", "component_id")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents without all but one of each group of near texts; all columns stay.

    The one with the smallest doc_id stays, ties by fingerprint and hash of the text; of
    a group without any doc_id the one with the least fingerprint. Rows that share a
    doc_id stay apart if their texts are not near; of rows with the same doc_id and text
    the one with the least hash of all columns stays, whatever the run.
    """
    rows, place = numbered(docs)
    rows = rows.select("*", F.col(place["doc_id"]).cast("long").alias("id"), F.xxhash64(F.coalesce(place["text"], F.lit(""))).alias("hash"))
    prints = written(rows.select("id", "hash", F.col(place["text"]).alias("text")).mapInArrow(_fingerprints, "id long, hash long, fp long"), "prints")
    of_root = prints.join(_labels(prints.select(F.col("id").alias("doc_id"), "fp"), radius, False), "fp").groupBy("root")
    stays = of_root.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "hash")).alias("s"))
    stays = written(stays.select(F.col("s.none").alias("kept_none"), F.coalesce("s.id", F.lit(0)).alias("kept_id"), F.col("s.hash").alias("kept_hash")), "kept")
    # plain keys without nulls, so that what the join deals serves the window too
    keyed = rows.withColumns({"none": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))})
    joined = keyed.join(stays, [F.col("none") == F.col("kept_none"), F.col("id") == F.col("kept_id"), F.col("hash") == F.col("kept_hash")])
    whole = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t])
    one = joined.withColumn("nth", F.row_number().over(W.partitionBy("none", "id", "hash").orderBy(whole))).filter("nth = 1")
    return one.select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)
