"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is domain, language, source. A node's budget goes to its children by
their weights; a child that cannot use its share (its capacity is the tokens below
it times the most epochs) passes the shortage to its siblings, and only what no
sibling can take goes to the ancestors' siblings: capacities are summed upward
first, then budgets are filled downward. Each leaf takes whole epochs and then a
token-prefix of one more, in an order seeded by epoch: documents as long as the
budget is not reached, the one that reaches it included.

Tokens are words between blanks, counted over whole texts. Null texts have none; null
sources and languages are nodes of their own (named ''). Documents without tokens come
with whole epochs only. Siblings that share a rest get whole tokens that add up to it.
Rows without doc_id are documents like others. The order of a leaf is seeded by doc_id
and text; rows equal in both stand together as one entry with their number, and as many
of them are taken as the budget needs (``select_mixed``: all or none). Extra columns are
ignored or stay, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrollsift.llm.common import NON_BLANK_RUN, documents, named, numbered, text_or_empty, written

SEED = 17
#: Tokens wanted, as parts of a thousand of all tokens; most epochs of a leaf.
BUDGET, EPOCHS = 700, 2
#: Integer weights by node name; a node that isn't listed has weight 1.
WEIGHTS = {"domain": {"core": 3, "web": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src1": 2, "src2": 2}}
#: Sources of the domain "core"; all others are "web".
CORE = ("src1", "src2", "src3", "src4", "src5")
LEVELS = ("domain", "lang", "source")
#: About as many documents share a bucket of the prefix search.
BUCKET_ROWS = 2000


def token_count(text: Column) -> Column:
    """Words between blanks, counted in one pass."""
    return F.regexp_count(text, F.lit(NON_BLANK_RUN)).cast("long")


def leaf_columns(lang: str = "lang", source: str = "source", core: tuple[str, ...] = CORE) -> list[Column]:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    domain = F.when(name(source).isin(*core), "core").otherwise("web")
    return [domain.alias("domain"), name(lang).alias("lang"), name(source).alias("source")]


def leaves(docs: DataFrame, core: tuple[str, ...] = CORE) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, digest) for each row; digest: what its text hashes to."""
    text = text_or_empty()
    return named(docs, "doc_id", "text", "lang", "source").select("doc_id", *leaf_columns(core=core), token_count(text).alias("n_tokens"), F.md5(text).alias("digest"))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for node, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == node, w).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Share ``budget`` among siblings by ``weight``, none above its ``capacity``; adds ``share``.

    Siblings are taken by capacity a weight; as long as one's capacity is below what
    the weights give it of the rest, it is filled. The others share the rest.
    """
    order = [F.col("capacity") / F.col("weight"), *[F.col(c) for c in LEVELS if c in nodes.columns]]
    w = W.partitionBy(*parent).orderBy(*order)
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    left = F.greatest(F.lit(0), F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    ranked = nodes.withColumn("_left", left).withColumn("_weights", F.sum("weight").over(after))
    full = F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight")
    ranked = ranked.withColumn("_full", F.min(full.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
    # the first that isn't filled knows what is left for all that aren't
    whole = W.partitionBy(*parent)
    rest = F.max(F.when(~F.col("_full"), F.struct("_weights", "_left"))).over(whole)
    upto = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    # differences of rounded running shares: none is lost
    share = F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr("(rest._left * _upto) div rest._weights - (rest._left * (_upto - weight)) div rest._weights"))
    return ranked.withColumn("rest", rest).withColumn("_upto", upto).withColumn("share", share).drop("_left", "_weights", "_full", "rest", "_upto")


def budgets(sizes: DataFrame, weights: dict = WEIGHTS, budget: int = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens) of each leaf -> the same with ``share``, its token budget."""
    tree = sizes.withColumn("capacity", F.col("tokens") * epochs)
    total = (sizes.agg(F.sum("tokens")).first()[0] or 0) * budget // 1000
    nodes, have = tree.withColumn("b0", F.lit(total).cast("long")), []
    for k, level in enumerate(LEVELS):
        have.append(level)
        level_nodes = nodes.groupBy(*have, f"b{k}").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        filled = fill(level_nodes, have[:-1] or [f"b{k}"], f"b{k}").select(*have, F.col("share").alias(f"b{k + 1}"))
        nodes = nodes.join(filled, have)
    return nodes.select(*LEVELS, "tokens", F.col("b3").alias("share"))


ENTRY = ("doc_id", "digest", "n_tokens")


def _place(seed: int, whole: str = "whole", doc_id: str = "doc_id", digest: str = "digest") -> Column:
    """Where an entry stands in the order of its leaf's last epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(whole), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(digest)))


def _key(place: Column, doc_id: str = "doc_id", digest: str = "digest") -> Column:
    return F.struct(place.alias("place"), F.col(doc_id).alias("doc_id"), F.col(digest).alias("digest"))


def leaf_plan(rows: DataFrame, weights: dict, budget: int, epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, whole, cut, quota, n): whole epochs of each leaf, the last entry of
    its prefix, how many of that entry's n equal rows the budget needs.

    The prefix is found without gathering the leaf: equal rows are counted as one entry
    before any shuffle, entries fall into buckets by the first digits of their seeded
    order, buckets are summed, and only the bucket in which the budget is reached is put
    in order.
    """
    on = list(LEVELS)
    sizes = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "sizes")
    shares = budgets(sizes, weights, budget, epochs).join(sizes.select(*LEVELS, "rows"), on)
    whole = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(epochs)).cast("long")
    plan = written(shares.withColumn("whole", whole).withColumn("need", F.col("share") - F.col("whole") * F.col("tokens")), "shares")
    hexes = 12
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long")
    at = F.conv(F.substring("place", 1, hexes), 16, 10).cast("double") / float(16**hexes)
    placed = rows.join(plan, on).withColumn("place", _place(seed)).withColumn("bucket", F.floor(at * buckets).cast("long"))
    sums = placed.groupBy(*LEVELS, "bucket", "need").agg(F.sum("n_tokens").alias("tokens_in"))
    before = F.coalesce(F.sum("tokens_in").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = sums.withColumn("before", before).filter("need > before and need <= before + tokens_in")
    edge = written(reached.select(*LEVELS, "bucket", "before"), "edge")
    entries = placed.join(edge, [*LEVELS, "bucket"]).groupBy(*LEVELS, "before", "need", "place", *ENTRY).agg(F.count("*").alias("n"))
    own = W.partitionBy(*LEVELS).orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    sum_ = F.col("before") + F.coalesce(F.sum(F.col("n_tokens") * F.col("n")).over(own), F.lit(0))
    quota = F.least("n", F.when(F.col("n_tokens") > 0, F.ceil((F.col("need") - F.col("sum")) / F.col("n_tokens"))).otherwise(F.col("n")))
    taken = entries.withColumn("key", _key(F.col("place"))).withColumn("sum", sum_).filter("sum < need")
    last = taken.groupBy(*LEVELS).agg(F.max_by(F.struct("key", quota.cast("long").alias("quota"), "n"), "key").alias("last"))
    out = plan.select(*LEVELS, "whole").join(last, on, "left").select(*LEVELS, "whole", F.col("last.key").alias("cut"), F.col("last.quota").alias("quota"), F.col("last.n").alias("n"))
    return written(out, "plan")


def _last_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(domain, lang, source, last_row): of an entry that is taken in part, the last row that is.

    Its rows are counted by the task that wrote them; only one task's are put in order.
    """
    split = plan.filter("quota < n").select(*LEVELS, "cut", "quota")
    same = [F.col(f"r.{c}") == F.col(f"s.{c}") for c in LEVELS] + [F.col("r.doc_id").eqNullSafe(F.col("s.cut.doc_id")), F.col("r.digest") == F.col("s.cut.digest")]
    own = rows.alias("r").join(split.alias("s"), same).select(*[f"r.{c}" for c in LEVELS], "r.row", "s.quota", F.shiftright("r.row", 33).alias("part"))
    parts = own.groupBy(*LEVELS, "part", "quota").agg(F.count("*").alias("in"))
    before = F.coalesce(F.sum("in").over(W.partitionBy(*LEVELS).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = parts.withColumn("left", F.col("quota") - before).filter("left > 0 and left <= in").select(*LEVELS, "part", "left")
    nth = F.row_number().over(W.partitionBy(*LEVELS).orderBy("row"))
    return own.join(reached, [*LEVELS, "part"]).withColumn("nth", nth).filter("nth = left").select(*LEVELS, F.col("row").alias("last_row"))


def mixed(docs: DataFrame, weights: dict = WEIGHTS, budget: int = BUDGET, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): how often each row is taken."""
    rows = written(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    plan = leaf_plan(rows, weights, budget, epochs, seed)
    plan = written(plan.join(_last_rows(rows, plan), list(LEVELS), "left"), "plan")
    key = _key(_place(seed))
    taken = (key < F.col("cut")) | (key.eqNullSafe(F.col("cut")) & F.coalesce(F.col("row") <= F.col("last_row"), F.lit(True)))
    copies = F.col("whole") + F.coalesce(taken.cast("long"), F.lit(0))
    return rows.join(plan, list(LEVELS)).select("doc_id", *LEVELS, "n_tokens", copies.alias("copies"))


def select_mixed(docs: DataFrame, weights: dict = WEIGHTS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """Documents of a mix without repeats: those in each leaf's prefix; all columns stay.

    Texts aren't shuffled as long as Spark finds the leaves' plan small enough to broadcast.
    """
    plan = leaf_plan(written(leaves(docs), "leaves"), weights, budget, 1, seed)
    rows, place = numbered(docs)
    digest = F.md5(F.coalesce(F.col(place["text"]), F.lit(""))).alias("digest")
    tagged = rows.select("*", F.struct(*leaf_columns(place["lang"], place["source"]), digest).alias("leaf"))
    same = [F.col(f"leaf.{c}") == F.col(f"plan.{c}") for c in LEVELS]
    key = _key(_place(seed, "plan.whole", place["doc_id"], "leaf.digest"), place["doc_id"], "leaf.digest")
    known = tagged.join(plan.select(F.struct("*").alias("plan")), same)
    return known.filter((F.col("plan.whole") > 0) | F.coalesce(key <= F.col("plan.cut"), F.lit(False))).select(*rows.columns).toDF(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def _case(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


def _fill_sql(k: int) -> str:
    """One level of the tree in SQL; b(k) is the parent's budget."""
    have = ", ".join(LEVELS[: k + 1])
    parent = ", ".join(LEVELS[:k]) or "1"
    order = f"capacity / weight, {have}"
    return f"""
nodes{k} AS (SELECT {have}, b{k}, sum(tokens) * {EPOCHS} AS capacity, {_case(LEVELS[k])} AS weight FROM tree{k} GROUP BY ALL),
ranked{k} AS (SELECT *, greatest(0, b{k} - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rem,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM nodes{k}),
flagged{k} AS (SELECT *, bool_and(capacity * ws <= rem * weight) OVER (PARTITION BY {parent} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS is_full FROM ranked{k}),
shared{k} AS (SELECT *, max(CASE WHEN NOT is_full THEN ROW(ws, rem) END) OVER (PARTITION BY {parent}) AS r,
  sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS upto FROM flagged{k}),
filled{k} AS (SELECT {have}, CASE WHEN is_full THEN capacity ELSE r[2] * upto // r[1] - r[2] * (upto - weight) // r[1] END AS b{k + 1} FROM shared{k}),
tree{k + 1} AS (SELECT * FROM tree{k} JOIN filled{k} USING ({have})),"""


def mixing_sql(source: str = "documents") -> str:
    return f"""
WITH rows AS (SELECT doc_id, CASE WHEN coalesce(source, '') IN {CORE} THEN 'core' ELSE 'web' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS digest FROM {source}),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows GROUP BY ALL),
tree0 AS (SELECT *, (SELECT sum(tokens) FROM leaf) * {BUDGET} // 1000 AS b0 FROM leaf),
{"".join(_fill_sql(k) for k in range(3))}
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN b3 // tokens ELSE {EPOCHS} END AS whole, b3 - CASE WHEN tokens > 0 THEN b3 // tokens ELSE {EPOCHS} END * tokens AS need FROM tree3),
placed AS (SELECT *, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest) AS place FROM rows JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < need AS t FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CAST(t AS INT) AS BIGINT) AS copies FROM taken
"""


OP3_SQL = mixing_sql()
