"""Three-tier line filter: repeated lines, scored lines, clustered lines.

captures: (capture_id, session_id, ts, output). Lines keep their ordinal; a session's
lines are ordered by (ts, capture_id, line_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry, Tier2

CAPTURE = ("session_id", "capture_id")


def explode_lines(captures: DataFrame) -> DataFrame:
    """One row for each line: (session_id, ts, capture_id, line_no, line)."""
    return captures.select("session_id", "ts", "capture_id", F.posexplode(T.lines(F.col("output"))).alias("line_no", "line"))


def tier1(lines: DataFrame, registry: Registry) -> DataFrame:
    """Keep the first few lines of each normalized form within a session.

    row_number with a bound lets Spark cut each task's rows before the shuffle, so
    a form that fills a session costs a few rows a task.
    """
    w = W.partitionBy("session_id", "normalized").orderBy("ts", "capture_id", "line_no")
    numbered = lines.withColumn("normalized", registry.normalize_tier1(F.col("line"))).withColumn("occurrence", F.row_number().over(w))
    return numbered.filter(F.col("occurrence") <= registry.tier1.max_occurrences)


def tier1_stats(lines: DataFrame, registry: Registry) -> DataFrame:
    """Distinct forms and lines of each session."""
    forms = lines.withColumn("normalized", registry.normalize_tier1(F.col("line"))).groupBy("session_id", "normalized").count()
    return forms.groupBy("session_id").agg(F.count("*").alias("patterns"), F.sum("count").alias("occurrences"))


def floor_rank(n: Column, p: float) -> Column:
    """1-based rank of the percentile by floor index; the product is taken in FLOAT."""
    index = F.floor(n.cast("float") * F.lit(p).cast("float"))
    return F.least(index, n - 1) + 1


def tier2_scores(lines: DataFrame, registry: Registry) -> DataFrame:
    """Score of each line and its parts, against its own capture, to six decimals; ``bits`` is its entropy."""
    weights: Tier2 = registry.tier2
    whole, same = W.partitionBy(*CAPTURE), W.partitionBy(*CAPTURE, "line")
    order = whole.orderBy("line_no")
    # each line is taken apart once, before the shuffle; the line before it lends its set.
    # the windows by capture come first, so that the others find their rows dealt already
    taken = lines.withColumn("_set", T.character_set(F.col("line"))).withColumn("bits", T.shannon_entropy(F.col("line"))).withColumn("_technical", registry.technical(F.col("line")))
    seen = (
        taken.withColumn("total_lines", F.count("*").over(whole))
        .withColumn("_previous", F.lag("line").over(order))
        .withColumn("_previous_set", F.lag("_set").over(order))
        .withColumn("freq", F.count("*").over(same))
    )
    change = F.when(F.col("_previous").isNull(), F.lit(1.0)).when(F.col("line") == F.col("_previous"), F.lit(0.0)).otherwise(1 - T.jaccard(F.col("_set"), F.col("_previous_set")))
    parts = {
        "entropy": F.round(F.col("bits") * weights.entropy, 6),
        "uniqueness": F.round((1 - F.col("freq") / F.col("total_lines")) * weights.uniqueness, 6),
        "technical": F.round(F.col("_technical") * weights.technical, 6),
        "change": F.round(change * weights.change, 6),
    }
    scored = seen.select("*", *[c.alias(n) for n, c in parts.items()])
    return scored.withColumn("score", F.round(F.col("entropy") + F.col("uniqueness") + F.col("technical") + F.col("change"), 6)).drop("_set", "_previous", "_previous_set", "_technical")


def tier2(lines: DataFrame, registry: Registry) -> DataFrame:
    """Lines whose score reaches the capture's percentile; ties stay."""
    return tier2_bounded(lines, registry).filter("score >= threshold")


def tier2_bounded(lines: DataFrame, registry: Registry) -> DataFrame:
    """All lines with their score and the capture's threshold."""
    by_score = W.partitionBy(*CAPTURE).orderBy("score")
    ranked = tier2_scores(lines, registry).withColumn("rank", F.row_number().over(by_score))
    at = F.max(F.when(F.col("rank") == floor_rank(F.col("total_lines"), registry.tier2.percentile), F.col("score")))
    return ranked.withColumn("threshold", at.over(W.partitionBy(*CAPTURE))).drop("rank")


def tier3(lines: DataFrame, registry: Registry) -> DataFrame:
    """Clusters of lines of one capture that are equal once normalized.

    A form with fewer lines than the least size gives one cluster a line; one with
    more than the most is cut into consecutive runs. Lines that bring their entropy
    (``bits``) along aren't taken apart again.
    """
    config = registry.tier3
    if config.chosen() == "highest_entropy" and "bits" not in lines.columns:
        lines = lines.withColumn("bits", T.shannon_entropy(F.col("line")))
    form = W.partitionBy(*CAPTURE, "pattern")
    placed = (
        lines.withColumn("pattern", registry.normalize_tier3(F.col("line")))
        .withColumn("_n", F.count("*").over(form))
        .withColumn("_i", F.row_number().over(form.orderBy("line_no")) - 1)
    )
    small, large = F.col("_n") < config.min_size, F.col("_n") > config.max_size
    split = F.when(small, F.col("_i")).when(large, F.floor(F.col("_i") / config.max_size)).otherwise(F.lit(0))
    best = {
        "first": F.min_by("line", "line_no"),
        "longest": F.max_by("line", F.struct(F.octet_length("line"), F.col("line_no"))),
        "highest_entropy": F.max_by("line", F.struct(F.round("bits", 6), F.col("line_no"))),
    }[config.chosen()]
    kind = F.when(small, F.lit("singleton")).when(large, F.lit("split")).otherwise(F.lit("count"))
    return (
        placed.withColumn("split_no", split.cast("long"))
        .withColumn("kind", kind)
        .groupBy(*CAPTURE, "pattern", "split_no", "kind")
        .agg(
            best.alias("representative"),
            F.count("*").alias("size"),
            F.min("line_no").cast("long").alias("first_seen"),
            F.max("line_no").cast("long").alias("last_seen"),
            F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda m: m.line).alias("members"),
        )
    )


def cluster_metadata(clusters: DataFrame) -> DataFrame:
    """Clusters with their metadata as JSON: what kind it is, the form and the places."""
    named = F.struct(F.col("size").alias("count"), "pattern", "first_seen", "last_seen", F.col("kind"))
    return clusters.withColumn("metadata", F.to_json(named))


def filter_pipeline(captures: DataFrame, registry: Registry) -> DataFrame:
    """All three tiers; clusters of each capture."""
    return tier3(tier2(tier1(explode_lines(captures), registry), registry), registry)


def filter_stats(captures: DataFrame, registry: Registry) -> DataFrame:
    """Lines before and after each tier, clusters, and the reduction, for each capture.

    The tiers run once; clusters are counted from the sizes of their forms.
    """
    key, config = list(CAPTURE), registry.tier3
    given = captures.select(*CAPTURE, F.size(T.lines(F.col("output"))).cast("long").alias("input_lines"))
    bounded = tier2_bounded(tier1(explode_lines(captures), registry), registry).withColumn("kept", F.col("score") >= F.col("threshold"))
    forms = bounded.groupBy(*key, "kept", F.when(F.col("kept"), registry.normalize_tier3(F.col("line"))).alias("form")).agg(F.count("*").alias("n"))
    n = F.col("n")
    clusters = F.when(n < config.min_size, n).when(n > config.max_size, F.ceil(n / config.max_size)).otherwise(F.lit(1))
    counts = forms.groupBy(*key).agg(F.sum("n").alias("tier1_lines"), F.sum(F.when(F.col("kept"), n)).alias("tier2_lines"), F.sum(F.when(F.col("kept"), clusters)).alias("clusters"))
    joined = given.join(counts, key, "left").fillna(0, ["tier1_lines", "tier2_lines", "clusters"])
    reduction = F.when(F.col("input_lines") > 0, F.round((1 - F.col("clusters") / F.col("input_lines")) * 100, 6)).otherwise(F.lit(0.0))
    return joined.withColumn("reduction_percent", reduction)
