"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollsift.llm.common import discard, written


def _sum(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step over directed pairs (u, v).

    Each u learns the least of itself and its partners. The larger partners
    (large star) or the smaller ones and u (small star) are tied to that least.
    The minima are written apart, so that a hot u is an ordinary skewed join.
    """
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    joined = pairs.join(least, "u")
    if keep_larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        ends = F.explode(F.array("u", "v")).alias("a")
        out = joined.select(ends, F.col("m").alias("b"))
    edges = written(out.filter("a != b").distinct(), "edges")
    discard(least)
    return edges


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) undirected links between longs -> (a, b): each linked node but the
    least of its component, with that least node.

    Empty input gives no rows. Self links and repeated links count for nothing.
    Each round writes its edges to the shared folder; no node's links are ever
    gathered, only minima.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b")
        .distinct(),
        "edges",
    )
    before = _sum(edges)
    for _ in range(max_rounds):
        if not before[0]:
            return edges
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both, True)
        older, edges = edges, _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        discard(older, large)
        after = _sum(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def labelled(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, least) and links (a, b) between fingerprints -> (fp, root, component_id): the least
    fingerprint and the smallest non-null ``least`` of the component.

    Fingerprints are the nodes, so that those which only rows without doc_id have link like others.
    """
    roots = components(links).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = written(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "labels")
    discard(rooted)
    return out
