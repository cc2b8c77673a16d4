"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The
ledger holds a row for each batch of rules that a blob was scanned by, so a run
scans a blob only by the (rule, version) pairs that it has not seen; findings are
then joined back to all paths that have the blob.

Null texts count as empty, which has a blob of its own and no findings. Rows that share
a path are its versions. Copies, repeated rows and null doc_ids all get their blob's
findings; rows stay one for one. Spans that start together stand in the order of their
rules. Very long texts are scanned whole. Extra columns are ignored, whatever their
names. An empty table gives no rows and no ledger rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import count_kind, documents, named, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values; their order breaks ties among spans that start together.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # runs are maximal, so a least length in the pattern finds the same spans
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
SPAN = "struct<start:int,rank:int,kind:string,end:int,rule:string>"
LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points: the parts between the matches give the offsets."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        start = acc.at + F.length(x["0"])
        end = start + F.length(x["1"])
        value = F.regexp_extract(x["1"], rule.pattern, rule.group) if rule.group else x["1"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.key).alias("rule"))
        kept = F.when(F.length(value) >= rule.least, F.array_append(acc.out, span)).otherwise(acc.out)
        return F.when(x["1"].isNull(), acc).otherwise(F.struct(end.alias("at"), kept.alias("out")))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    # a text without any match is not split
    return F.when(text.rlike(rule.pattern), F.aggregate(F.arrays_zip(between.alias("0"), found.alias("1")), start, step, lambda a: a.out)).otherwise(empty)


def addressed(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, text, blob)"""
    text = text_or_empty()
    return named(docs, path, "text").select(F.col(path).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (see LEDGER) for the blobs of ``docs``: only unseen (blob, rule version) pairs are scanned.

    Copies collapse before and after the shuffle, so a hot blob costs one row a task.
    """
    blobs = addressed(docs).groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("unseen", keys)
    else:
        seen = ledger.select("blob", F.explode("scanned").alias("s")).filter(F.col("s").isin(*[r.key for r in rules]))
        seen = seen.groupBy("blob").agg(F.collect_set("s").alias("seen"))  # at most one for each rule
        todo = blobs.join(seen, "blob", "left").withColumn("unseen", F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))).filter(F.size("unseen") > 0)
    text, parts = F.col("text"), []
    for rank, rule in enumerate(rules):
        found = rule_spans(text, rule, rank)
        if ledger is not None:
            found = F.when(F.array_contains("unseen", rule.key), found).otherwise(F.array().cast(f"array<{SPAN}>"))
        parts.append(found)
    return todo.select("blob", F.col("unseen").alias("scanned"), F.concat(*parts).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): the ledger's spans of the given rules, in their versions, joined back to all paths."""
    paths = addressed(docs).select("path", "blob")
    hits = ledger.filter(F.size("spans") > 0)
    spans = hits.select("blob", F.explode("spans").alias("span")).filter(F.col("span.rule").isin(*[r.key for r in rules]))
    spans = written(spans.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans")), "findings")  # one text's spans
    none = F.array().cast(f"array<{SPAN}>")
    return paths.join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def scan_incremental(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """One run: (findings of all paths, ledger with this run's rows)."""
    new = written(scan(docs, ledger, rules), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings(docs, whole, rules), whole


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents after two runs of the ledger.

    The first run has the rules but the last, and half of the paths have arrived; the second
    has all rules and all paths. What the first one scanned is read from its ledger: its blobs
    are scanned by the added rule only, blobs that arrived since by all.
    """
    docs = documents(spark, sf_dir)
    arrived = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    ledger = written(scan(arrived, None, RULES[:-1]), "ledger")
    found, _ = scan_incremental(docs, ledger)
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [count_kind("spans", r.kind).alias(f"n_{r.kind}") for r in RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def _sql_spans(rank: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    value = f"regexp_extract(v[i], '{p}', {rule.group})"
    return f"""
  SELECT doc_id, {rank} AS k, '{rule.kind}' AS kind,
         list_filter(list_transform(range(1, len(v) + 1), lambda i: struct_pack(
           keep := length({value}) >= {rule.least},
           s := list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0),
           n := length(v[i]))), lambda z: z.keep) AS found
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS b
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


OP1_SQL = f"""
WITH each AS ({" UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(RULES))}),
rows AS (SELECT doc_id, k, kind, unnest(found) AS f FROM each),
joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)},
         string_agg(kind || ':' || CAST(f.s AS BIGINT) || ':' || CAST(f.s + f.n AS BIGINT), ',' ORDER BY f.s, k) AS spans
  FROM rows GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""
