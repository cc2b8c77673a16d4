"""Embedding providers, and the job that fills both indexes from chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from threading import Thread
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.operators.index import KeywordIndex, VectorIndex

#: Grams whose place a worker remembers.
REMEMBERED = 500_000


class Provider(Protocol):
    """What makes vectors: a model behind a name and a dimension; executors get a copy of it."""

    model: str
    dimension: int

    def embed(self, text: str) -> np.ndarray: ...

    def embed_batch(self, texts: list[str]) -> list[np.ndarray | None]: ...


@dataclass
class HashingProvider:
    """Offline stand-in for a model: signed hashed words and character trigrams, unit length.

    The first 32 bits of a gram's MD5 give its place and sign, so SQL can tell them too.
    """

    model: str = "all-MiniLM-L6-v2"

    def __post_init__(self) -> None:
        if self.model not in D.MODELS:
            raise ValueError(f"unknown embedding model: {self.model}")
        self.dimension = D.MODELS[self.model]
        self._known: dict[str, int] = {}

    def embed(self, text: str) -> np.ndarray:
        vector = self._vector(text)
        if vector is None:
            raise ValueError("text to embed cannot be empty")
        return vector

    def embed_batch(self, texts: list[str]) -> list[np.ndarray | None]:
        """A vector for each text; none for an empty one."""
        return [self._vector(t) for t in texts]

    def _vector(self, text: str | None) -> np.ndarray | None:
        words = (text or "").lower().split()
        if not words:
            return None
        grams = [g for w in words for g in (w, *(w[i : i + 3] for i in range(len(w) - 2)))]
        h = np.fromiter(map(self._hash, grams), np.int64, len(grams))
        v = np.bincount(h % self.dimension, np.where(h >> 31, 1.0, -1.0), self.dimension)
        return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)

    def _hash(self, gram: str) -> int:
        found = self._known.get(gram)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = self._known[gram] = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        return found


def embedded(docs: DataFrame, provider: Provider) -> DataFrame:
    """(id, text) -> (id, vector, model); rows with empty texts stay, without a vector."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if v is None else _checked(v, provider.dimension) for v in provider.embed_batch(texts.tolist())], dtype=object)

    vector = F.pandas_udf(embed, "array<float>")(F.col("text"))
    return docs.select("id", vector.alias("vector"), F.lit(provider.model).alias("model"))


def _checked(vector: np.ndarray, dimension: int) -> list[float]:
    if len(vector) != dimension:
        raise ValueError(f"the model gave {len(vector)} dimensions, not {dimension}")
    return [float(x) for x in vector]


def process(chunks: DataFrame, provider: Provider, keywords: KeywordIndex, vectors: VectorIndex) -> DataFrame:
    """Embed (id, text) chunks and add them to both indexes; one row: processed, failed.

    A chunk without a vector has failed and goes into neither index. The vector index is
    written first and read again, so no chunk is embedded twice.
    """
    vectors.add(embedded(chunks, provider).filter("vector is not null"))
    done = chunks.join(vectors.rows().select("id"), "id", "left_semi")
    keywords.add(done.select("id", "text"))
    marked = chunks.join(vectors.rows().select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    return marked.agg(F.count_if(F.col("_done")).alias("processed"), F.count_if(F.col("_done").isNull()).alias("failed"))


def process_background(chunks: DataFrame, provider: Provider, keywords: KeywordIndex, vectors: VectorIndex) -> Thread:
    """The same in a thread of the driver."""
    thread = Thread(target=process, args=(chunks, provider, keywords, vectors), daemon=True)
    thread.start()
    return thread
