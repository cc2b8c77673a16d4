"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the words, word pairs and pairs over one skipped word of a whole
text, hashed to 2^BITS coordinates and counted as present or absent. Per-coordinate
rates and L1 keep few weights; only those are sent to the executors, so their
size is bounded by the table and in practice by L1.

Training rows: at most ``max_rows`` doc_ids of each label (a documented bound), in hash
order. A doc_id counts once: with labels of both kinds as toxic, with several texts by
the text of least hash. Rows held out by crc32(doc_id) mod 5 = 0, null labels, null
doc_ids and null texts are never used. Without labels of both kinds every score is 0.
The driver reads the sample in PARTS parts, one at a time; a row has at most 2^BITS
coordinates however long its text. Scoring: null texts count as empty and get the score
of the intercept; rows are kept one for one, repeated or not; very long texts are scored
whole; extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import documents, hash_sample, named, packed, slices, table, written
from scrollsift.llm.hashing import WORD_BYTES, pair, word_hashes

BITS = 20
FOLDS, HELD_OUT = 5, 0
MAX_ROWS = 12_000
#: Parts of the sample, of which the driver holds one.
PARTS = 8


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(coordinates, text of each) of the words, pairs and skip pairs of packed texts."""
    h, first = word_hashes(data, off, WORD_BYTES)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.int64), text
    for gap in (1, 2):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        yield (pair(h[:-gap][same], h[gap:][same], gap) >> shift).astype(np.int64), text[gap:][same]


@dataclass(frozen=True)
class Weights:
    at: np.ndarray
    value: np.ndarray
    intercept: float

    def shifted(self, by: float) -> Weights:
        return Weights(self.at, self.value, self.intercept + by)

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.at] = self.value
        return w


class Ftrl:
    """FTRL-proximal: a rate for each coordinate, L1 for sparsity, L2 for small steps."""

    def __init__(self, alpha=2.0, beta=1.0, l1=6.0, l2=0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a text whose present coordinates are ``at`` (distinct)."""
        at = np.append(at, 1 << BITS)  # the intercept
        w = self.weight(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g

    def weights(self) -> Weights:
        w = self.weight(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w[:-1])
        return Weights(at.astype(np.int32), w[at].astype(np.float32), float(w[-1]))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(o, toxic, at, part): the coordinates of the texts to learn from, one row a doc_id."""
    known = named(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = written(hash_sample(known, "toxic", ("doc_id",), max_rows), "picked")
    texts = named(docs, "doc_id", "text").filter("text is not null")
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * max_rows ids

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ats, of = (np.concatenate(x) for x in zip(*features(*packed(part)), strict=True))
                cells = np.unique(of << BITS | ats)
                cut = np.searchsorted(cells, np.arange(part.num_rows + 1) << BITS)
                at = (cells & ((1 << BITS) - 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at))
                yield pa.RecordBatch.from_arrays([*map(part.column, ("o", "toxic", "h")), lists], names=["o", "toxic", "h", "at"])

    found = rows.select("text", "o", "toxic", F.xxhash64("text").alias("h")).mapInArrow(run, "o long, toxic int, h long, at array<int>")
    one = found.groupBy("o", "toxic").agg(F.min_by("at", "h").alias("at"))
    return written(one.withColumn("part", F.pmod("o", F.lit(PARTS))).repartitionByRange(PARTS, "part"), "sample")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, passes: int = 3) -> Weights | None:
    """Fit on the texts of a sample of ``labels`` (doc_id, toxic; held-out rows left out).

    At most 2 * max_rows ids are broadcast; executors turn the sampled texts into
    coordinates, and the driver learns from one part of them after the other.
    """
    sample = sampled(docs, labels, max_rows)
    if sample.select("toxic").distinct().count() < 2:
        return None
    model = Ftrl()
    for k in range(passes):
        for p in range(PARTS):
            rows = sample.filter(F.col("part") == p).select("o", "toxic", "at").toArrow()
            o, y, at = rows["o"].to_numpy(), rows["toxic"].to_numpy(), rows["at"].combine_chunks()
            off, flat = at.offsets.to_numpy(), at.values.to_numpy()
            for i in np.lexsort((y, o if k % 2 == 0 else -o)):
                model.learn(flat[off[i] : off[i + 1]], int(y[i]))
    known = named(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)")
    n = dict(known.groupBy("toxic").agg(F.approx_count_distinct("doc_id", 0.02)).collect())
    share = [min(1.0, max_rows / max(1, n[i])) for i in (0, 1)]
    return model.weights().shifted(float(np.log(share[0] / share[1])))  # undoes the uneven sampling


def score(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, score), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = None if weights is None else weights.dense()
        for batch in batches:
            for part in slices(batch, 2 << 20):
                total = np.zeros(part.num_rows)
                if dense is not None:
                    found = []
                    for at, text in features(*packed(part)):
                        hit = np.flatnonzero(dense[at])
                        found.append(text[hit] << BITS | at[hit])
                    cells = np.unique(np.concatenate(found))
                    total = weights.intercept + np.bincount(cells >> BITS, dense[cells & ((1 << BITS) - 1)], part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(total, -60, 60))) if dense is not None else total
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(folds: int = FOLDS, fold: int = HELD_OUT):
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    weights = train(docs, labels.filter(~held_out()))
    return score(docs, weights).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
