"""Queries of the three-tier line filter."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry, Tier3
from scrollsift.operators import filtering as L
from scrollsift.plans import common as C
from scrollsift.sources import tables

REGISTRY = Registry()
#: A coarse cluster form, so that prose falls into clusters of more than one line.
COARSE = ((r"[^ .,;:!?]+", "w"),)
COARSE_MIN, COARSE_MAX = 2, 5
AT = ["session_id", "capture_id", "line_no"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return L.explode_lines(tables.captures(spark, d))


def line_explode(spark, d):
    return C.plain(_lines(spark, d).select(*AT, "line"))


def tier1_normalize(spark, d):
    return C.plain(_lines(spark, d).select(*AT, REGISTRY.normalize_tier1(F.col("line")).alias("normalized")))


def tier1_dedup(spark, d):
    return C.plain(L.tier1(_lines(spark, d), REGISTRY).select(*AT, "occurrence", "line"))


def tier1_conversations(spark, d):
    return C.plain(L.tier1(L.explode_lines(tables.turns(spark, d)), REGISTRY).select(*AT, "occurrence"))


def tier1_stats(spark, d):
    return L.tier1_stats(_lines(spark, d), REGISTRY)


def shannon_entropy(spark, d):
    return C.plain(_lines(spark, d).select(*AT, F.round(T.shannon_entropy(F.col("line")), 6).alias("entropy")))


def change_score(spark, d):
    w = W.partitionBy("session_id", "capture_id").orderBy("line_no")
    pairs = _lines(spark, d).withColumn("previous", F.lag("line").over(w)).filter("previous is not null")
    return C.plain(pairs.select(*AT, F.round(T.change_score(F.col("line"), F.col("previous")), 6).alias("change")))


def technical_score(spark, d):
    return C.plain(_lines(spark, d).select(*AT, F.round(REGISTRY.technical(F.col("line")), 6).alias("technical")))


def line_frequency(spark, d):
    return _lines(spark, d).groupBy("session_id", "capture_id", "line").agg(F.count("*").alias("freq"))


def _tier1(spark, d):
    return L.tier1(_lines(spark, d), REGISTRY)


def tier2_scores(spark, d):
    return C.plain(L.tier2_scores(_tier1(spark, d), REGISTRY).select(*AT, "entropy", "uniqueness", "technical", "change", "score"))


def tier2_filter(spark, d):
    return C.plain(L.tier2(_tier1(spark, d), REGISTRY).select(*AT, "score", "threshold", "line"))


SHOWN = ["session_id", "capture_id", "pattern", "split_no", "kind", "representative", "size", "first_seen", "last_seen", "members"]


def _shown(clusters: DataFrame) -> DataFrame:
    return C.plain(clusters.withColumn("members", F.array_join("members", "\n")).select(*SHOWN))


def _coarse(strategy: str) -> Registry:
    return replace(REGISTRY, tier3=Tier3(COARSE_MIN, COARSE_MAX, strategy, COARSE))


def _clusters(strategy: str):
    def query(spark, d):
        return _shown(L.tier3(_lines(spark, d), _coarse(strategy)))

    return query


def filter_pipeline(spark, d):
    return _shown(L.filter_pipeline(tables.captures(spark, d), REGISTRY))


def filter_stats(spark, d):
    return C.plain(L.filter_stats(tables.captures(spark, d), REGISTRY))


QUERIES = {f.__name__: f for f in (line_explode, tier1_normalize, tier1_dedup, tier1_conversations, tier1_stats, shannon_entropy, change_score, technical_score, line_frequency, tier2_scores, tier2_filter, filter_pipeline, filter_stats)}
QUERIES |= {f"tier3_clusters_{s}": _clusters(s) for s in ("first", "longest", "highest_entropy")}

BASE = f"WITH {C.CAPTURES}, {C.LINES}"
TURNS = "caps AS (SELECT turn AS capture_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS ts, coalesce(text, '') AS output FROM conversations)"
KEY = "session_id, capture_id, line_no"
ALL3 = f"{BASE}, {C.FORMS}, {C.SCORES}"
_DEFAULT = C.clusters_sql("kept2", C.TIER3_RULES, D.CLUSTER_MIN, D.CLUSTER_MAX, C.ORDER[D.STRATEGY])

ORACLES = {
    "line_explode": f"{BASE} SELECT {KEY}, line FROM lines",
    "tier1_normalize": f"{BASE}, {C.FORMS} SELECT {KEY}, normalized FROM forms",
    "tier1_dedup": f"{BASE}, {C.FORMS} SELECT {KEY}, occurrence, line FROM kept1",
    "tier1_conversations": f"WITH {TURNS}, {C.LINES}, {C.FORMS} SELECT {KEY}, occurrence FROM kept1",
    "tier1_stats": f"{BASE}, {C.FORMS} SELECT session_id, count(DISTINCT normalized) AS patterns, count(*) AS occurrences FROM forms GROUP BY session_id",
    "shannon_entropy": f"{BASE} SELECT {KEY}, round({C.entropy_sql('line')}, 6) AS entropy FROM lines",
    "change_score": f"{BASE}, two AS (SELECT *, lag(line) OVER (PARTITION BY session_id, capture_id ORDER BY line_no) AS previous FROM lines) SELECT {KEY}, round({C.change_sql('line', 'previous')}, 6) AS change FROM two WHERE previous IS NOT NULL",
    "technical_score": f"{BASE} SELECT {KEY}, round({C.technical_sql('line')}, 6) AS technical FROM lines",
    "line_frequency": f"{BASE} SELECT session_id, capture_id, line, count(*) AS freq FROM lines GROUP BY ALL",
    "tier2_scores": f"{ALL3} SELECT {KEY}, entropy, uniqueness, technical, change, score FROM scored",
    "tier2_filter": f"{ALL3} SELECT {KEY}, score, threshold, line FROM kept2",
    "filter_pipeline": f"{ALL3}, {_DEFAULT} SELECT {', '.join(SHOWN)} FROM clusters",
    "filter_stats": f"""{ALL3}, {_DEFAULT},
c0 AS (SELECT session_id, capture_id, len(q) AS input_lines FROM listed),
c1 AS (SELECT session_id, capture_id, count(*) AS tier1_lines FROM kept1 GROUP BY ALL),
c2 AS (SELECT session_id, capture_id, count(*) AS tier2_lines FROM kept2 GROUP BY ALL),
c3 AS (SELECT session_id, capture_id, count(*) AS clusters FROM clusters GROUP BY ALL)
SELECT session_id, capture_id, input_lines, coalesce(tier1_lines, 0) AS tier1_lines, coalesce(tier2_lines, 0) AS tier2_lines, coalesce(c3.clusters, 0) AS clusters,
  CASE WHEN input_lines > 0 THEN round((1 - coalesce(c3.clusters, 0) / CAST(input_lines AS DOUBLE)) * 100, 6) ELSE 0.0 END AS reduction_percent
FROM c0 LEFT JOIN c1 USING (session_id, capture_id) LEFT JOIN c2 USING (session_id, capture_id) LEFT JOIN c3 USING (session_id, capture_id)""",
}
ORACLES |= {f"tier3_clusters_{s}": f"{BASE}, {C.clusters_sql('lines', COARSE, COARSE_MIN, COARSE_MAX, o)} SELECT {', '.join(SHOWN)} FROM clusters" for s, o in C.ORDER.items()}
