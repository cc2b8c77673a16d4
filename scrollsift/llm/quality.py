"""Quality rules: robust multivariate outliers, with DataFrame functions only.

Each document gets a vector of transformed statistics: rates of marks, capitals, repeated
words and repeated lines, and the length of its words. The chance error of a rate shrinks
with the square root of the words, so a rate counts by its distance from its group's median
times that root. For each language and source, deterministic starts and concentration steps
seek the half of the vectors whose covariance has the least determinant: all starts take a
few steps, the best one goes on until its determinant settles. That estimate is reweighted
once, and documents whose Mahalanobis distance from it is too large are rejected. A statistic
that is the same for half of a group's documents has no robust spread there and is left out
for that group.

All statistics are sums and percentiles over grid values, combined before any shuffle, so a
source with most of the rows is no burden for one task. Sources of a language with fewer than
LEAST_ROWS usable rows are estimated together; if those are too few as well, the method
rejects none of them. Null texts count as empty; null languages and sources form groups of
their own. A text's words and windows are held by one task, however long it is. Rows are kept
one for one, whatever their doc_id and however often repeated; extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import BLANK, discard, documents, named, text_or_empty, written

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WIDTH = 50, 50, 3
SYMBOLS = r"#*$%&|<>"

FEATURES = ("marks", "capitals", "repeats", "lines", "length")
#: Steps of a rate and of a standardized value; words from which a text's own style outweighs chance.
GRID, FINE, CHANCE_WORDS = 1000, 100, 1000
SHARE = 0.5
#: Steps that all starts take, and the most that the best one takes; a unit settles when its log determinant falls by less.
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 30, 1e-3
LEAST_ROWS = 10 * len(FEATURES)
#: Least part of a feature's robust variance that the others leave unexplained.
LEAST_PIVOT = 1e-4
REWEIGHT, TAIL = 0.975, 1e-4
GROUP = ("lang", "source")
#: Bits of a window's place beside its hash.
PLACE_BITS = 20


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, base statistics, base_failed, features)

    What a text is taken apart into is dropped as soon as it is counted: first the text
    and its lines, then its words, then the hashes of its windows.
    """
    docs, text = named(docs, "doc_id", "text", *GROUP), F.col("_text")
    with_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    taken = docs.select("doc_id", *[F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in GROUP], text_or_empty().alias("_text")).select(
        "doc_id",
        *GROUP,
        F.array_remove(F.split(text, BLANK + "+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), with_word).alias("_lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).alias("_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("_capitals"),
    )
    words, own = F.col("_words"), ["doc_id", *GROUP, "n_symbols", "_marks", "_capitals"]
    window = lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, REPEAT_WIDTH)])
    hashes = F.slice(F.transform(words, window), 1, F.size(words) - (REPEAT_WIDTH - 1))
    hashed = taken.select(
        *own,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        F.when(F.size(words) >= REPEAT_WIDTH, hashes).otherwise(F.array().cast("array<long>")).alias("_hashes"),
    )
    out = repeated_words(hashed, "_hashes", "n_repeat_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    per = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    vector = {
        "marks": F.sqrt(per("_marks", "n_words")),
        "capitals": F.sqrt(per("_capitals", "n_words")),
        "repeats": F.sqrt(per("n_repeat_words", "n_words")),
        "lines": F.sqrt(per("n_dup_lines", "_n_lines")),
        "length": F.log(F.greatest(F.lit(1.0), per("word_chars", "n_words"))),
    }
    on_grid = [F.round(vector[f] * GRID).cast("long").alias(f) for f in FEATURES]
    return out.withColumn("base_failed", failed).select("doc_id", *GROUP, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *on_grid)


def repeated_words(rows: DataFrame, hashes: str, name: str, place_bits: int = PLACE_BITS) -> DataFrame:
    """``rows`` with the words in windows whose hash occurs twice or more, instead of the hashes of all windows.

    The upper bits of each hash stand beside its place in one number, so that sorting
    numbers brings equal windows together. Where those bits take different hashes for
    one, or a text has more windows than places, whole hashes are sorted instead.
    """
    low = (1 << place_bits) - 1
    n = F.size(hashes)
    counted = rows.withColumn("_distinct", F.size(F.array_distinct(hashes)))
    packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<long>")
    some = F.col("_distinct") < n
    sorted_ = counted.withColumn("_packed", F.when(some & (n <= low), F.sort_array(packed)).otherwise(none))
    upper = lambda x: F.shiftright(x, place_bits)
    beside = lambda i: upper(F.get("_packed", i))
    again = F.filter("_packed", lambda x, i: (upper(x) == beside(i + 1)) | F.coalesce(upper(x) == beside(i - 1), F.lit(False)))
    exact = F.size(F.array_distinct(F.transform("_packed", upper))) == F.col("_distinct")
    places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    placed = sorted_.withColumn("_places", F.when(some, F.when((n <= low) & exact, places).otherwise(_places(F.col(hashes)))).otherwise(F.array().cast("array<int>")))
    return placed.withColumn(name, _covered(F.col("_places")).cast("long")).drop(hashes, "_distinct", "_packed", "_places")


def _places(hashes: Column) -> Column:
    """Places (0-based, in order) of the hashes that occur twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1
    # each pair beside its neighbours in hash order
    after = F.concat(F.slice(pairs, 2, last), F.array(F.lit(None)))
    before = F.concat(F.array(F.lit(None)), F.slice(pairs, 1, last))
    rows = F.arrays_zip(pairs.alias("p"), before.alias("b"), after.alias("a"))
    again = F.filter(rows, lambda r: (r.p.h == r.b.h) | (r.p.h == r.a.h))
    return F.sort_array(F.transform(again, lambda r: r.p.i))


def _covered(places: Column) -> Column:
    """Words covered by windows at these places: the next window may begin sooner."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + REPEAT_WIDTH).alias("until"), (acc.n + i + REPEAT_WIDTH - F.greatest(acc.until, i)).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc.n)


def chi2_cdf(x: float, k: float) -> float:
    """Lower regularized gamma function P(k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """What a covariance of the innermost share of normal vectors is to be multiplied with."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]


def _active(f: str) -> Column:
    return F.col(f"s_{f}") > 0


def _dimension() -> Column:
    """Features that a group has a spread of."""
    return reduce(lambda s, f: s + _active(f).cast("int"), FEATURES, F.lit(0))


def _by_dimension(value) -> Column:
    """value(p) for each number of active features p."""
    out = F.lit(value(1))
    for p in range(2, len(FEATURES) + 1):
        out = F.when(_dimension() == p, F.lit(value(p))).otherwise(out)
    return out


def units(rows: DataFrame) -> DataFrame:
    """(lang, source, unit): which rows are estimated together; null unit: too few for an estimate."""
    sizes = written(rows.groupBy(*GROUP).agg(F.count("*").alias("n")), "sizes")
    alone = F.col("n") >= LEAST_ROWS
    rest = written(sizes.filter(~alone).groupBy("lang").agg(F.sum("n").alias("all")), "rest")
    of = F.when(alone, F.to_json(F.struct("lang", "source"))).when(F.col("all") >= LEAST_ROWS, F.to_json(F.struct("lang")))
    return written(sizes.join(rest, "lang", "left").select(*GROUP, of.alias("unit")), "units")


def scales(rows: DataFrame) -> DataFrame:
    """(unit, q_f, s_f): each feature's median and robust spread around it, by the square root of the words."""
    middle = written(rows.groupBy("unit").agg(*[F.percentile(f, 0.5).alias(f"q_{f}") for f in FEATURES]), "middle")
    off = rows.join(middle, "unit").select("unit", *[F.round(F.abs(_rooted(f)) * FINE).cast("long").alias(f) for f in FEATURES])
    spread = off.groupBy("unit").agg(*[(F.percentile(f, 0.5) * 1.4826 / FINE).alias(f"s_{f}") for f in FEATURES])
    return written(middle.join(spread, "unit"), "scales")


def _rooted(f: str) -> Column:
    """A feature's distance from its median in steps of the grid, by the square root of the words."""
    return (F.col(f) - F.col(f"q_{f}")) * F.sqrt(F.least("n_words", F.lit(CHANCE_WORDS)))


def standardized(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The features as multiples of the robust spread (zero where there is none), with the spreads."""
    z = [F.when(_active(f), _rooted(f) / F.col(f"s_{f}")).otherwise(0.0).alias(f) for f in FEATURES]
    kept = [c for c in rows.columns if c not in FEATURES]
    return rows.join(known, "unit").select(*kept, *z, *[f"s_{f}" for f in FEATURES])


def _estimate(rows: DataFrame, keys: tuple[str, ...], factor: Column, name: str) -> DataFrame:
    """Mean, Cholesky factor (columns m_f, l_f_g) and log determinant of each group of standardized rows."""
    sums = [F.avg(f).alias(f"m_{f}") for f in FEATURES] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in _pairs()]
    out = rows.groupBy(*keys).agg(*[F.first(f"s_{f}").alias(f"s_{f}") for f in FEATURES], *sums).withColumn("_factor", factor)
    factors = []  # each may name those before it
    for i, a in enumerate(FEATURES):
        for j, b in enumerate(FEATURES[: i + 1]):
            value = F.col(f"c_{a}_{b}") * F.col("_factor")
            for c in FEATURES[:j]:
                value = value - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            if a == b:
                value = F.when(_active(a), F.sqrt(F.greatest(value, F.lit(LEAST_PIVOT)))).otherwise(1.0)
            else:
                value = value / F.col(f"l_{b}_{b}")
            factors.append(value.alias(f"l_{a}_{b}"))
    out = out.select("*", *factors)
    det = reduce(lambda s, f: s + F.log(F.col(f"l_{f}_{f}")), FEATURES, F.lit(0.0))
    return written(out.select(*keys, det.alias("log_det"), *[f"m_{f}" for f in FEATURES], *[f"l_{a}_{b}" for a, b in _pairs()]), name)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution; features without spread are zero throughout."""
    y: dict[str, Column] = {}
    for a in FEATURES:
        rest = F.col(a) - F.col(f"m_{a}")
        for b in list(y):
            rest = rest - F.col(f"l_{a}_{b}") * y[b]
        y[a] = rest / F.col(f"l_{a}_{a}")
    return reduce(lambda s, v: s + v * v, y.values(), F.lit(0.0))


def _step(rows: DataFrame, now: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Concentration: the estimate of the half that is nearest to the estimate before."""
    return _inner(rows.join(now, "unit").withColumn("_d", _distance()), keys)


def _inner(placed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Estimate of the SHARE of each group's rows with the least ``_d``, to a 64th of an octave."""
    placed = placed.withColumn("_level", F.round(F.log2(F.col("_d") + 1e-6) * 64).cast("long"))
    cut = written(placed.groupBy(*keys).agg(F.percentile("_level", SHARE).alias("_cut")), "cut")
    inner = placed.join(cut, list(keys)).filter("_level <= _cut").select(*keys, *FEATURES, *[f"s_{f}" for f in FEATURES])
    out = _estimate(inner, keys, _by_dimension(lambda p: consistency(SHARE, p)), "step")
    discard(cut)
    return out


def _starts(rows: DataFrame) -> DataFrame:
    """Rows once for each start, with what orders them: the length of the standardized vector, its
    greatest part, and its distance by the covariances of its squashed parts and of its direction."""
    squares = reduce(lambda s, f: s + F.col(f) * F.col(f), FEATURES, F.lit(0.0))
    greatest = reduce(F.greatest, [F.abs(F.col(f)) for f in FEATURES])
    squash = lambda f: F.tanh(F.col(f))
    turn = lambda f: F.col(f) / F.sqrt(F.greatest(squares, F.lit(1e-12)))
    spreads = [f"s_{f}" for f in FEATURES]
    kinds = F.array(*[F.struct(F.lit(k).alias("start"), *[v(f).alias(f) for f in FEATURES]) for k, v in ((2, squash), (3, turn))])
    made = rows.select("unit", *spreads, F.explode(kinds).alias("v")).select("unit", *spreads, "v.*")
    shapes = _estimate(made, ("unit", "start"), F.lit(1.0), "shapes")
    zero = {f"m_{f}": F.lit(0.0) for f in FEATURES}
    by_shape = rows.join(shapes.withColumns(zero), "unit").select("unit", "start", *FEATURES, *spreads, _distance().alias("_d"))
    plain = F.explode(F.array(F.struct(F.lit(0).alias("start"), squares.alias("_d")), F.struct(F.lit(1).alias("start"), (greatest * greatest).alias("_d"))))
    return rows.withColumn("_s", plain).select("unit", "_s.start", *FEATURES, *spreads, "_s._d").unionByName(by_shape)


def estimates(rows: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each unit of standardized rows."""
    keys = ("unit", "start")
    now = _inner(_starts(rows), keys)
    for _ in range(FIRST_STEPS):
        now = _step(rows, now, keys)
    best = now.groupBy("unit").agg(F.min(F.struct("log_det", "start")).alias("b")).select("unit", F.col("b.start").alias("start"))
    now = written(now.join(best, list(keys)).drop("start"), "best")
    done, old = [], F.col("log_det").alias("old")
    for _ in range(MOST_STEPS):  # units whose determinant falls no more are done with
        step = _step(rows, now, ("unit",))
        lower = step.join(now.select("unit", old), "unit").filter(F.col("log_det") < F.col("old") - SETTLED).drop("old")
        lower = written(lower, "lower")
        done.append(written(now.join(lower.select("unit"), "unit", "left_anti"), "settled"))
        discard(now, step)
        now = lower
        if now.isEmpty():
            break
    now = written(reduce(DataFrame.unionByName, done, now), "least")
    discard(*done)
    near = rows.join(now, "unit").filter(_distance() <= _by_dimension(lambda p: chi2_quantile(REWEIGHT, p))).select("unit", *FEATURES, *[f"s_{f}" for f in FEATURES])
    return _estimate(near, ("unit",), _by_dimension(lambda p: consistency(REWEIGHT, p)), "reweighted")


def quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Statistics, base_failed, squared distance (null without an estimate or a spread) and kept, for each row."""
    stats = written(statistics(docs), "statistics")
    good = stats.filter("not base_failed")
    named_ = stats.join(units(good), list(GROUP), "left")
    usable = named_.filter("not base_failed and unit is not null").select("unit", "n_words", *FEATURES)
    known = scales(usable)
    fitted = estimates(standardized(usable, known))
    placed = named_.join(known, "unit", "left").join(fitted, "unit", "left")
    z = {f: F.when(_active(f), _rooted(f) / F.col(f"s_{f}")).otherwise(0.0) for f in FEATURES}
    out = placed.withColumns(z).withColumn("distance", F.when(_dimension() > 0, _distance()))
    inside = F.coalesce(F.col("distance") <= _by_dimension(lambda p: chi2_quantile(1 - tail, p)), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
