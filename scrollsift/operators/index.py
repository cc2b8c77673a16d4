"""Keyword and vector indexes that are stored, added to, searched and cleared.

A keyword index keeps postings by buckets of terms, so that a query reads its own terms
only; what the score needs of the whole is a row for each change. A vector index keeps
unit vectors by cells around centroids; a search looks at the nearest cells, or exactly
at all of them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T
from scrollsift.sources import tables

#: Buckets of terms that the postings are stored by.
BUCKETS = 64
#: Rows that centroids are learned from at most, the most centroids, and the cells a search looks at.
SAMPLE_ROWS, MOST_CELLS, PROBES = 20_000, 1024, 8


def tokens(text):
    """Lower-case runs of letters and digits, none of over 40 bytes."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) <= D.TOKEN_BYTES))


def postings(docs: DataFrame) -> DataFrame:
    """(id, text) -> (term, doc, id, tf, positions, dl); a row added twice is two documents."""
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), "id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    placed = numbered.select("doc", "id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
    return placed.groupBy("term", "doc", "id", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def query_terms(query: str) -> list[str]:
    """Terms of a query by the index's own rules."""
    words, word = [], ""
    for c in query.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    return [w for w in words if len(w.encode()) <= D.TOKEN_BYTES]


@dataclass(frozen=True)
class KeywordIndex:
    """Postings below a folder, in generations: ``add`` writes one, ``delete`` notes ids, ``merge`` makes one of all."""

    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, docs: DataFrame, folder: str) -> KeywordIndex:
        """A new index of (id, text)."""
        index = cls(docs.sparkSession, folder)
        index.clear()
        index.add(docs)
        return index

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> KeywordIndex:
        if not all(tables.exists(spark, f"{folder}/{t}") for t in ("postings", "totals")):
            raise ValueError(f"no keyword index in {folder}")
        return cls(spark, folder)

    def _table(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if tables.exists(self.spark, path) else None

    def _put(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> None:
        """One more generation. Large buckets are written by several tasks, small ones together."""
        found = postings(docs).withColumn("bucket", F.crc32("term") % BUCKETS)
        generation = tables.shared_folder(self.spark, "generation").rsplit("-", 1)[1]
        by_term = found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        self._put(by_term.withColumn("generation", F.lit(generation)), "postings", "bucket")
        sizes = docs.select("id", F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("dl"))
        self._put(sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")), "totals")
        self._put(sizes, "sizes")

    def delete(self, ids: DataFrame) -> None:
        """Take out all documents of these ids that were added so far; later ones count again after ``merge``."""
        gone = self.sizes().join(ids.select("id").distinct(), "id", "left_semi")
        self._put(gone.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("length")), "totals")
        self._put(ids.select("id").distinct(), "deleted")

    def _kept(self, rows: DataFrame) -> DataFrame:
        gone = self._table("deleted")
        return rows if gone is None else rows.join(gone, "id", "left_anti")

    def sizes(self) -> DataFrame:
        """(id, dl): each document and its terms."""
        return self._kept(self.spark.read.parquet(f"{self.folder}/sizes"))

    def merge(self) -> KeywordIndex:
        """The same index in one generation, without what was deleted, in a folder of its own beside this one."""
        folder = f"{self.folder}-merged"
        new = KeywordIndex(self.spark, folder)
        new.clear()
        kept = self._kept(self.spark.read.parquet(f"{self.folder}/postings"))
        new._put(kept.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings", "bucket")
        new._put(self.sizes(), "sizes")
        new._put(new.sizes().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")), "totals")
        return new

    def clear(self) -> None:
        tables.delete(self.spark, self.folder)

    def size(self) -> DataFrame:
        """One row: documents in the index and distinct ids (an id may be added more than once)."""
        return self.sizes().agg(F.count("*").alias("documents"), F.count_distinct("id").alias("ids"))

    def read(self, terms: list[str]) -> DataFrame:
        """Postings of these terms; other buckets aren't opened."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        rows = self.spark.read.parquet(f"{self.folder}/postings")
        return self._kept(rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)))

    def bm25(self, query: str, k: int | None = None) -> DataFrame:
        """(id, score) of the documents that have any term of the query, best first."""
        terms = sorted(set(query_terms(query)))
        if not terms:
            raise ValueError("query text cannot be empty")
        totals = self.spark.read.parquet(f"{self.folder}/totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        n = totals.select(F.col("n").cast("double")).scalar()
        mean = totals.select(F.greatest(F.col("length"), F.lit(1)) / F.greatest(F.col("n"), F.lit(1))).scalar()
        rows = self.read(terms)
        having = rows.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
        idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (D.BM25_K1 + 1) / (F.col("tf") + D.BM25_K1 * (1 - D.BM25_B + D.BM25_B * F.col("dl") / mean))
        scored = rows.select("generation", "doc", "id", "term", "tf", "dl").join(F.broadcast(having), "term").withColumn("part", part)
        hits = scored.groupBy("generation", "doc", "id").agg(F.round(F.sum("part"), 6).alias("score")).select("id", "score")
        ranked = hits.orderBy(F.desc("score"), "id")
        return ranked if k is None else ranked.limit(k)

    def phrase(self, query: str) -> DataFrame:
        """(id): documents with the query's terms one after the other, from the terms' positions."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("query text cannot be empty")
        at = F.array(*[F.lit(i) for i in range(len(terms))])
        places = F.filter(F.transform(at, lambda i: F.when(F.get(F.array(*map(F.lit, terms)), i) == F.col("term"), i)), lambda i: i.isNotNull())
        starts = F.flatten(F.transform(places, lambda i: F.transform("positions", lambda p: F.struct((p - i).alias("start"), i.alias("i")))))
        found = self.read(sorted(set(terms))).select("generation", "doc", "id", F.explode(starts).alias("s"))
        whole = found.groupBy("generation", "doc", "id", "s.start").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms))
        return whole.select("generation", "doc", "id").distinct().select("id")


def removed(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents, postings or vectors without those of the given ids."""
    return table.join(ids.select("id"), "id", "left_anti")


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): the k vectors of the query's dimension with the greatest cosine, exactly."""
    norm = float(np.linalg.norm(np.array(query, np.float64))) or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    fit = vectors.filter(F.size("vector") == len(query))
    scored = fit.select("id", F.round(T.dot(F.col("vector"), q) / F.sqrt(T.dot(F.col("vector"), F.col("vector"))), 6).alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(k)


def dimension_errors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors that an index of this dimension can't take."""
    return vectors.filter(F.coalesce(F.size("vector") != dimension, F.lit(True))).select("id", F.size("vector").alias("dimension"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of lists of equal length."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query, id, score): the k nearest vectors of each query, exactly.

    Both sides are dealt to blocks of about ``block`` rows, whatever their ids. Each pair
    of blocks is one product of matrices that keeps the k best of each query; those meet by
    query. No task holds more than two blocks, and no pair of rows is written out.
    """

    def blocks(rows: DataFrame, name: str, id_: str) -> DataFrame:
        n = F.greatest(F.lit(1), F.ceil(rows.agg(F.count("*")).scalar() / float(block))).cast("int")
        dealt = rows.withColumn("_n", n).withColumn(name, F.pmod(F.xxhash64(id_), F.col("_n")).cast("int"))
        parts = dealt.groupBy(name).agg(F.max("_n").alias(f"{name}_n"), F.collect_list(F.struct(F.col(id_).alias("id"), F.col("vector").cast("array<float>").alias("v"))).alias(f"{name}_rows"))
        return parts

    asked = blocks(queries, "q", "id")
    n_asked = F.greatest(F.lit(1), F.ceil(queries.agg(F.count("*")).scalar() / float(block))).cast("int")
    held = blocks(vectors, "b", "id").withColumn("q", F.explode(F.sequence(F.lit(0), n_asked - 1)))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (batch.column(c).slice(i, 1).flatten() for c in ("q_rows", "b_rows"))
                ids, score = np.asarray(right.field("id")), np.round(_matrix(left.field("v")) @ _matrix(right.field("v")).T, 6)
                top = [np.lexsort((ids, -row))[:k] for row in score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(left.field("id")), [len(t) for t in top])), pa.array(np.concatenate([ids[t] for t in top])), pa.array(np.concatenate([r[t] for r, t in zip(score, top, strict=True)]))],
                    names=["query", "id", "score"],
                )

    found = held.join(asked, "q").select("q_rows", "b_rows").mapInArrow(run, "query long, id long, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)  # k rows of each block
    rows = found.groupBy("query").agg(best.alias("best")).select("query", F.explode("best").alias("b"))
    return rows.select("query", "b.id", (-F.col("b.s")).alias("score"))


@dataclass(frozen=True)
class VectorIndex:
    """Unit vectors below a folder, by the cell of their nearest centroid."""

    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, vectors: DataFrame, folder: str, dimension: int, cells: int | None = None) -> VectorIndex:
        """A new index of (id, vector). Centroids are learned from at most SAMPLE_ROWS rows in
        hash order; every row of the dimension is indexed."""
        spark = vectors.sparkSession
        index = cls(spark, folder)
        tables.delete(spark, folder)
        fit = vectors.filter(F.size("vector") == dimension)
        n = fit.count()
        share = fit.filter(F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53) * n < SAMPLE_ROWS)
        sample = share.select(F.col("vector").cast("array<float>").alias("v")).limit(SAMPLE_ROWS).toArrow()["v"].combine_chunks()
        centroids = _centroids(_matrix(sample), cells or max(1, min(MOST_CELLS, int(n**0.5))))
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        spark.createDataFrame([(dimension,)], "dimension int").coalesce(1).write.parquet(f"{folder}/shape")
        index.add(fit)
        return index

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> VectorIndex:
        if not tables.exists(spark, f"{folder}/centroids"):
            raise ValueError(f"no vector index in {folder}")
        return cls(spark, folder)

    def dimension(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/shape").first()[0]

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        return np.array([r.centroid for r in rows]) if rows else np.zeros((0, self.dimension()))

    def add(self, vectors: DataFrame) -> None:
        """More vectors; those of another dimension are refused (``dimension_errors`` names them)."""
        centers = self.centroids()

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("vector"))
                cell = (x @ centers.T).argmax(1).astype(np.int32) if len(x) and len(centers) else np.zeros(len(x), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array(cell)], names=["id", "vector", "cell"])

        fit = vectors.filter(F.size("vector") == self.dimension()).select(F.col("id").cast("long"), F.col("vector").cast("array<float>"))
        placed = fit.mapInArrow(run, "id long, vector array<float>, cell int")
        placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/vectors")

    def rows(self) -> DataFrame:
        path = f"{self.folder}/vectors"
        schema = "id long, vector array<float>, cell int"
        return self.spark.read.schema(schema).parquet(path) if tables.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def size(self) -> int:
        return self.rows().count()

    def clear(self) -> None:
        """No vectors are left; centroids and dimension stay."""
        tables.delete(self.spark, f"{self.folder}/vectors")

    def search(self, query: list[float], k: int, probes: int | None = PROBES) -> DataFrame:
        """(id, score): the k nearest vectors in the cells nearest to the query; probes None: in all, exactly."""
        if len(query) != self.dimension():
            raise ValueError(f"the index has {self.dimension()} dimensions, the query {len(query)}")
        q = np.array(query, np.float64)
        q /= np.linalg.norm(q) or 1.0
        near = np.argsort(-(self.centroids() @ q), kind="stable")[:probes].tolist() or [0]  # without centroids there is one cell
        rows = self.rows() if probes is None else self.rows().filter(F.col("cell").isin(near))
        scored = rows.select("id", F.round(T.dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)


def _centroids(x: np.ndarray, cells: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means with seeded starts."""
    if not len(x):
        return np.zeros((0, 0))
    centers = x[np.random.default_rng(7).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(steps):
        cell = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centers)
    return centers
