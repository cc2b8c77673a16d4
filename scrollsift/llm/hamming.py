"""Links between 64-bit fingerprints within a Hamming radius, by masked tables.

Two mask families with a guarantee that every pair within the radius shares a
key in some table: a covering code and permuted blocks. Buckets of any size are
worked through: a bucket over ``BLOCK`` members is dealt to pairs of blocks, each
of them a group of its own, so that no task ever holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollsift.llm.common import written

BITS = 64
#: Most fingerprints in one block of a bucket.
BLOCK = 4096


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits are all outside one of them.

    Bit i carries a nonzero vector c(i) of radius + 1 bits; mask v has the bits
    whose <c(i), v> is odd. ``radius`` equations in radius + 1 unknowns have a
    nonzero solution v, and its mask avoids the differing bits.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]


def kept_blocks(radius: int, rows: int) -> int:
    """How many of radius + kept blocks a table keeps so that its keys outnumber the rows."""
    kept = 2
    while BITS * kept // (radius + kept) < min(rows.bit_length(), BITS - 16):
        kept += 1
    return kept


def block_masks(radius: int, kept: int = 2) -> list[int]:
    """Masks of permuted block tables: of radius + kept blocks each table keeps ``kept``."""
    n = radius + kept
    edge = [BITS * i // n for i in range(n + 1)]
    block = [((1 << edge[i + 1]) - 1) & ~((1 << edge[i]) - 1) for i in range(n)]
    return [sum(block[i] for i in c) for c in combinations(range(n), kept)]


def _links(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within the radius among these fingerprints."""
    left, out_a, out_b = np.arange(len(fp)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            near = left[hit]
            if len(near):
                out_a.append(np.full(len(near), node[x]))
                out_b.append(node[near])
                front.extend(near)
                left = left[~hit]
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return cat(out_a), cat(out_b)


def _near(fp: np.ndarray, n: np.ndarray, side: np.ndarray, table: np.ndarray, radius: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, rows of others within the radius) of one group.

    A group of one block (side -1) pairs all its members, one of two blocks only those
    of different sides. A pair counts in the first table that it shares a key in.
    """
    own = side < 1
    other = own if side[0] < 0 else ~own
    x, y, at_x, at_y = fp[own], fp[other], np.flatnonzero(own), np.flatnonzero(other)
    near = np.zeros(len(fp), np.int64)
    for s in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[s : s + 256, None] ^ y[None]) <= radius)
        i += s
        diff = x[i] ^ y[j]
        good = diff != 0
        for m in masks[: table[0]]:
            good &= diff & m != 0
        i, j = at_x[i[good]], at_y[j[good]]
        np.add.at(near, i, n[j])
        if side[0] >= 0:
            np.add.at(near, j, n[i])
    hit = np.flatnonzero(near)
    return fp[hit], near[hit]


def _worker(radius: int, masks: list[int] | None):
    """Over rows in the order of their group: links within each group, or with masks counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None if masks is None else np.array(masks, np.uint64)

        def emit(rows):
            g, fp = rows[0], rows[1].view(np.uint64)
            cut = np.flatnonzero(np.diff(g)) + 1
            start, stop = np.r_[0, cut], np.r_[cut, len(g)]
            if first is not None:
                found = [_near(fp[s:e], *(r[s:e] for r in rows[2:]), radius, first) for s, e in zip(start, stop, strict=True) if e > s + 1]
                a, b = (np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in enumerate((np.uint64, np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b)], names=["a", "b"])
            node = rows[1]
            two = start[stop - start == 2]
            hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            found = [(node[hit], node[hit + 1])]
            for s, e in zip(start[stop - start > 2], stop[stop - start > 2], strict=True):
                found.append(_links(fp[s:e], node[s:e], radius))
            a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([hi, lo], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if held is None else [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))
            if last:
                yield emit([x[:last] for x in now])
            held = [x[last:].copy() for x in now]
        if held is not None:
            yield emit(held)

    return run


def _dealt(prints: DataFrame, masks: list[int], block: int) -> DataFrame:
    """(g, fp, n, side, t): fingerprints by groups, each of one block or of two blocks of a bucket."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keys = prints.select("fp", "n", F.explode(tables).alias("k")).select("fp", "n", "k.t", F.xxhash64("k.t", "k.key").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "buckets")
    own, other = F.col("own"), F.col("other")
    return (
        keys.join(shared, "key")
        .withColumn("blocks", F.ceil(F.col("rows") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("g"), "fp", "n", F.when(own == other, -1).otherwise((own > other).cast("int")).alias("side"), "t")
    )


def hamming_links(prints: DataFrame, radius: int, masks: list[int], block: int = BLOCK) -> DataFrame:
    """Distinct ``fp`` -> (a, b): links within ``radius`` bits, named by their fingerprints.

    The links connect exactly the fingerprints that are connected by pairs within
    the radius; a group of m near copies yields about m links per table instead
    of m * (m - 1) / 2. Empty input gives no rows.
    """
    rows = _dealt(prints.select("fp", F.lit(1).alias("n")), masks, block).select("g", "fp")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_worker(radius, None), "a long, b long")


def hamming_counts(prints: DataFrame, radius: int, masks: list[int], block: int = BLOCK) -> DataFrame:
    """(fp, n), distinct fingerprints and their rows -> (fp, near): for each fingerprint
    how many rows have another one within ``radius`` bits, if any have.

    Every pair is counted once, in the first of the tables that it shares a key in; no
    pair leaves its task.
    """
    rows = _dealt(prints.select("fp", F.col("n").cast("long")), masks, block)
    found = rows.repartition("g").sortWithinPartitions("g").mapInArrow(_worker(radius, masks), "a long, b long")
    return found.groupBy(F.col("a").alias("fp")).agg(F.sum("b").alias("near"))
