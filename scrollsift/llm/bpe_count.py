"""Token counts by heap-and-linked-list byte-pair merging.

A pretoken's symbols stand in a linked list; the lowest-ranked adjacent pair is
popped from a heap and merged until none is left. The count is the number of
first symbols less the merges; no token identifiers are made.

Null texts count as empty (no bytes, no tokens). Special strings inside a text
are one token each, as the tokenizer file's library has it. Rows are kept one for
one, whatever their doc_id; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import documents, named

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Chunks whose counts a worker remembers, and the longest of them in characters.
CACHE, CACHED_CHARS = 400_000, 48

#: Unicode White_Space, and the pretoken pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Counts tokens; remembers the counts of short chunks, at most ``CACHE`` of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.first = [vocab[s] for s in byte_symbols()]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, chunk: str) -> int:
        n = sum(self.merge(p.encode("utf-8", "surrogatepass")) for p in PRETOKEN.findall(chunk))
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = n
        return n

    def merge(self, word: bytes) -> int:
        """Symbols left of one pretoken after all merges."""
        n = left = len(word)
        if n < 2:
            return n
        rank = self.rank.get
        sym = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if sym[i] < 0 or j >= n or rank(sym[i] << 32 | sym[j]) != r:
                continue  # this pair is gone
            sym[i], sym[j] = self.merged[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(sym[i] << 32 | sym[k])) is not None:
                    heappush(heap, x * n + i)
            if (p := before[i]) >= 0 and (x := rank(sym[p] << 32 | sym[i])) is not None:
                heappush(heap, x * n + p)
        return left

    def plain(self, text: str) -> int:
        if len(text) > 1 << 20:
            return sum(self[m[0]] for m in CHUNK.finditer(text))
        return sum(map(self.__getitem__, CHUNK.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=4)
def counter(tokenizer: str) -> Counter:
    return Counter(public_tokenizers.path(tokenizer))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens), row by row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
