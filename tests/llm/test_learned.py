"""Learned operators by held-out accuracy, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrollsift.llm import common, language, toxicity

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, letters int, o string"
ODD = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, "123 ... !", "en", None, 9), (None, "the and of that", "en", "a", 15), (4, "x" * 100_000, "en", "a", 100_000), (4, "x" * 100_000, "en", "a", 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, FOLDER)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "o") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def net(docs):
    return language.train(docs.filter(~language.held_out()))


def test_language_held_out_accuracy(spark, docs, net):
    rows = language.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out())
    right = rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_language_odd_rows(odd, net, spark):
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, net).collect()]
    assert len(got) == len(ODD)
    assert all(p == "und" and s == 0 for i, p, s in got if i in (1, 2, 3))
    assert language.train(odd.limit(0)) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    kept = language.keep_known(odd, net, 0.3)
    assert kept.columns == odd.columns and kept.count() == 3


def test_unlearned_script_is_rejected(spark, docs):
    foreign = ["Привет мир, это обычный текст на русском языке. " * 5, "이것은 특별한 것이 없는 평범한 한국어 텍스트입니다. " * 6, "Αυτό είναι ένα απλό κείμενο. " * 9, "这是一个普通的中文文本。" * 9]
    held = docs.filter(language.held_out() & F.col("text").rlike(r"\p{L}"))
    strange = spark.createDataFrame([(10**9 + 4 * i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    for langs in (("de", "en", "es", "fr"), ("de", "en", "fr")):
        learned = docs.filter(F.col("lang").isin(*langs)).unionByName(strange, allowMissingColumns=True)
        kept = corpus_pipeline.identify_language(spark, learned, FOLDER)
        assert kept.filter(F.col("doc_id") >= 10**9).count() == 0
        clean = held.filter(F.col("lang").isin(*langs))
        assert kept.join(clean.select("doc_id"), "doc_id", "left_semi").count() > 0.97 * clean.count()


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 256, b"b" * 257, b"c"]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    x, text = language.windows(np.frombuffer(b"".join(texts), np.uint8), off)
    assert text.tolist() == [1, 2, 2, 3]
    assert [bytes(r).rstrip(b"\0") for r in x] == [b"a" * 256, b"b" * 256, b"b", b"c"]


def test_toxicity_separates_held_out_rows(spark, docs):
    rows = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").toPandas()
    ranks, toxic = rows.score.rank(), rows.toxic == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert rows[rows.predicted == 1].toxic.mean() > 0.95


def test_toxicity_odd_rows(spark, odd):
    assert toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def plain_ftrl(rows, alpha, beta, l1, passes):
    """FTRL-proximal by its definition, coordinate by coordinate."""
    z, n = {}, {}

    def weight(k):
        s = z.get(k, 0.0)
        return 0.0 if abs(s) <= l1 else (np.sign(s) * l1 - s) / ((beta + np.sqrt(n.get(k, 0.0))) / alpha)

    for _ in range(passes):
        for at, y in rows:
            at = [*at, "intercept"]
            p = 1 / (1 + np.exp(-sum(map(weight, at))))
            for k, w in [(k, weight(k)) for k in at]:
                g, old = p - y, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
                n[k] = old + g * g
    return {k: w for k in z if (w := weight(k))}


def test_ftrl_equals_its_definition():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 8) + 30 * y), y) for y in rng.integers(0, 2, 300)]
    model = toxicity.Ftrl(l1=0.5)
    for _ in range(2):
        for at, y in rows:
            model.learn(at, int(y))
    want = plain_ftrl(rows, model.alpha, model.beta, model.l1, 2)
    got = model.weights()
    assert dict(zip(got.at.tolist(), got.value.tolist(), strict=True)) == pytest.approx({k: w for k, w in want.items() if k != "intercept"}, rel=1e-5)
    assert got.intercept == pytest.approx(want.get("intercept", 0.0))


def test_scores_are_sums_over_words_pairs_and_skip_pairs(spark):
    from scrollsift.llm import hashing

    text = "one two three two one two"
    h, _ = hashing.word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), hashing.WORD_BYTES)
    cells = {int(x) >> 44 for x in h}
    for gap in (1, 2):
        cells |= {int(hashing.pair(h[i : i + 1], h[i + gap : i + gap + 1], gap)[0]) >> 44 for i in range(len(h) - gap)}
    rng = np.random.default_rng(1)
    weights = toxicity.Weights(np.arange(1 << 20, dtype=np.int32), rng.normal(size=1 << 20).astype(np.float32), 0.25)
    total = 0.25 + sum(float(weights.value[c]) for c in cells)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert got == pytest.approx({1: 1 / (1 + np.exp(-total)), 2: 1 / (1 + np.exp(-0.25))})


def test_repeated_ids_and_labels_count_once_in_the_toxicity_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 2}") for i in range(200)] + [(2, "other"), (3, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0)] * 50 + [(2, 0)] * 50 + [(3, 0)], "doc_id long, toxic int")
    rows = toxicity.sampled(docs, labels, 1).collect()
    assert sorted(r.toxic for r in rows) == [0, 1]
    assert len(toxicity.sampled(docs, labels, 10).collect()) == 3


def test_repeated_rows_count_once_in_a_sample(spark):
    rows = spark.createDataFrame([("en", 1)] * 500 + [("en", i) for i in range(2, 40)] + [("de", 7)] * 9, "lang string, doc_id long")
    got = [r.lang for r in common.hash_sample(rows, "lang", ("doc_id",), 20).collect()]
    assert got.count("en") == 20 and got.count("de") == 1
    large = spark.range(20_000).select("id", (F.col("id") % 3).alias("of"))
    assert common.hash_sample(large, "of", ("id",), 50).groupBy("of").count().collect() == [(i, 50) for i in (0, 2, 1)] or {
        r["count"] for r in common.hash_sample(large, "of", ("id",), 50).groupBy("of").count().collect()
    } == {50}


def naive_probabilities(net, window):
    """One window through the network, filter by filter and place by place."""
    hidden = []
    for taps in net.taps:
        for f in range(taps.shape[2]):
            hidden.append(max(sum(float(taps[k, window[i + k], f]) for k in range(len(taps))) for i in range(len(window) - len(taps) + 1)))
    hidden = np.maximum(np.array(hidden) + net.bias, 0)
    z = hidden @ net.out + net.out_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_network_equals_naive_convolution(net):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    got = net.probabilities(x, net.pairs())
    for row, window in zip(got, x, strict=True):
        assert row == pytest.approx(naive_probabilities(net, window), abs=1e-5)


def test_training_steps_follow_the_gradient():
    rng = np.random.default_rng(3)
    x, y = rng.integers(97, 123, (64, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64)
    x[y == 1, 10:13] = (1, 2, 3)
    net = language.ByteNet.fresh(["a", "b"])
    loss = lambda: -np.log(net.probabilities(x, net.pairs())[np.arange(64), y]).mean()
    before = loss()
    net.fit(x, y, passes=20, size=64)
    assert loss() < 0.7 * before


def test_language_learns_from_whole_texts_and_bounded_rows(spark):
    rows = [(1, "a" * 3000, "x")] * 50 + [(2, "b" * 700, "y"), (3, "c", "y")]
    seen = []
    fit = language.ByteNet.fit
    language.ByteNet.fit = lambda self, x, y, *a: seen.append(np.bincount(y).tolist()) or fit(self, x, y, *a)
    try:
        language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5)
    finally:
        language.ByteNet.fit = fit
    assert seen == [[12, 4]]


def test_empty_tables(spark, docs, net):
    none = docs.limit(0)
    assert language.predict(none, net).count() == 0 == language.keep_known(none, net, 0.3).count()
    assert toxicity.score(none, toxicity.Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0, name


def test_pipeline_takes_odd_rows(spark, odd):
    before, n = odd.drop("letters", "o"), []
    for name, stage in corpus_pipeline.STAGES:
        before = common.written(stage(spark, before, FOLDER), name)
        n.append(before.count())
    assert n[0] == 2 and n[1:3] == [1, 1]  # the repeated text, learned from, then one of its rows


def test_pipeline_stages(spark, docs):
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, before, FOLDER), name)
        assert after.count() <= before.count()
        assert after.select("doc_id").distinct().count() == after.count()
        if name != "pieces":
            assert after.columns == columns
        before = after
    assert before.filter("not round_trip").count() == 0
    assert before.count() > 0.7 * docs.count()
