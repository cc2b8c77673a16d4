"""Hybrid retrieval: two rankings, reciprocal rank fusion, provenance, filters, reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T
from scrollsift.operators import index
from scrollsift.operators.embedding import Provider


@dataclass(frozen=True)
class Fusion:
    rrf_k: float = D.RRF_K
    semantic_weight: float = D.SEMANTIC_WEIGHT
    keyword_weight: float = D.KEYWORD_WEIGHT

    def __post_init__(self) -> None:
        if self.semantic_weight <= 0 or self.keyword_weight <= 0:
            raise ValueError("fusion weights must be positive")


@dataclass(frozen=True)
class Query:
    text: str
    limit: int = 10
    session: str | None = None
    tool: str | None = None
    since: int | None = None
    until: int | None = None
    prefilter: bool = False
    min_similarity: float = D.MIN_SIMILARITY

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("query text cannot be empty")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(id, score) -> rank from 1 of the best k; each task passes on k rows at most, and one task orders those."""
    best = hits.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def fuse(semantic: DataFrame, keyword: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """(id, rank) twice -> (id, score): weight / (k + rank) summed over both lists."""
    part = lambda d, w: d.select("id", (F.lit(w) / (F.lit(fusion.rrf_k) + F.col("rank"))).alias("s"))
    both = part(semantic, fusion.semantic_weight).unionByName(part(keyword, fusion.keyword_weight))
    return both.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))


def first_per_id(results: DataFrame) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc("score"))
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hydrated(scored: DataFrame, chunks: DataFrame, captures: DataFrame) -> DataFrame:
    """(id, score) with the chunk's text and where it comes from; nulls get their names."""
    rows = chunks.join(scored, "id").join(captures, "capture_id", "left")
    return rows.select(
        "id", "text", "score", "capture_id", "session_id", "blob_hash",
        F.coalesce("command", F.lit("(unknown)")).alias("command"), F.coalesce("tool", F.lit("unknown")).alias("tool"), "ts",
    )


def filtered(results: DataFrame, query: Query) -> DataFrame:
    """Results by session, tool, time and, if it is above zero, the least fused score."""
    out = results
    if query.session is not None:
        out = out.filter(F.col("session_id") == query.session)
    if query.tool is not None:
        out = out.filter(F.col("tool") == query.tool)
    if query.since is not None:
        out = out.filter(F.col("ts") >= query.since)
    if query.until is not None:
        out = out.filter(F.col("ts") <= query.until)
    return out.filter(F.col("score") >= query.min_similarity) if query.min_similarity > 0 else out


def overlap_scorer(query: str):
    """Offline reranker: the share of the query's terms that a text has."""
    terms = sorted(set(index.query_terms(query)))
    found = index.tokens(F.col("text"))
    return F.size(F.array_intersect(found, F.array(*map(F.lit, terms)))) / float(max(1, len(terms)))


def reranked(results: DataFrame, query: str, limit: int, candidates: int = D.RERANK_LIMIT, scorer=overlap_scorer) -> DataFrame:
    best = results.orderBy(F.desc("score"), "id").limit(candidates)
    return best.withColumn("score", F.round(scorer(query), 6)).orderBy(F.desc("score"), "id").limit(limit)


Vectors = DataFrame | index.VectorIndex


def nearest(vectors: Vectors, query: str | list[float], k: int, provider: Provider | None = None) -> DataFrame:
    """(id, score): the semantic step. A text is embedded by the provider; an index looks at
    its nearest cells, a table of vectors is scanned."""
    vector = [float(x) for x in provider.embed(query)] if isinstance(query, str) else query
    return vectors.search(vector, k) if isinstance(vectors, index.VectorIndex) else index.knn(vectors, vector, k)


def search(
    query: Query,
    vector: Provider | list[float],
    chunks: DataFrame,
    captures: DataFrame,
    vectors: Vectors,
    keywords: index.KeywordIndex,
    fusion: Fusion = Fusion(),
    rerank: bool = False,
    multiplier: int = D.SEARCH_MULTIPLIER,
) -> DataFrame:
    """Over-fetch from both indexes, fuse, hydrate, filter, order, cut.

    vector: the query's, or the provider that makes it of the query's text. Filters come
    after the over-fetch unless the query asks for a prefilter, which makes both rankings
    see the filtered chunks only.
    """
    n = query.limit * multiplier
    asked, provider = (vector, None) if isinstance(vector, list) else (query.text, vector)
    if query.prefilter:
        named = captures.withColumns({"score": F.lit(1.0), "tool": F.coalesce("tool", F.lit("unknown"))})
        ids = chunks.join(filtered(named, query).select("capture_id"), "capture_id", "left_semi").select("id")
        rows = vectors.rows() if isinstance(vectors, index.VectorIndex) else vectors
        semantic = nearest(rows.join(ids, "id", "left_semi"), asked, n, provider)
        keyword = keywords.bm25(query.text).join(ids, "id", "left_semi")
    else:
        semantic, keyword = nearest(vectors, asked, n, provider), keywords.bm25(query.text, n)
    fused = fuse(ranked(semantic, n), ranked(keyword, n), fusion)
    results = first_per_id(filtered(hydrated(fused, chunks, captures), query))
    if rerank:
        return reranked(results, query.text, query.limit)
    return results.orderBy(F.desc("score"), "id").limit(query.limit)


def listing(results: DataFrame) -> DataFrame:
    """Search results as they are shown."""
    return results.select("id", "score", "tool", "command", T.preview(F.col("text"), 80).alias("preview"))


def context(results: DataFrame, n: int = 20) -> DataFrame:
    """One row: the best n texts joined by rules, for a prompt; no model is called."""
    best = results.orderBy(F.desc("score"), "id").limit(n)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "text")))
    return best.agg(F.array_join(F.transform(parts, lambda p: p.text), "\n---\n").alias("context"))
