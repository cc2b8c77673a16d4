"""Operators with exact results: against SQL, libraries and brute force on small fixtures."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrollsift.llm import bpe_count, common, doc_prints, hamming, hashing, language, mixing, nbest, near_dup, pii, quality, queries, secret_ledger, toxicity
from scrollsift.llm.components import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept int, fp string"

#: Nulls, empty and odd texts, repeated rows, ties; columns whose names clash with inner ones.
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "word", "en", "a", 4), (None, "a text without an id here", "en", "a", 25),
    (5, "same same same same", "de", "b", 19), (5, "same same same same", "de", "b", 19), (6, "x" * 200_000, "en", "a", 200_000), (7, "token=abcdef12 AKIA" + "A" * 16, "en", "a", 35),
    (8, "ÄÖ über 😀 <|endoftext|> ▁", "de", "b", 24), (9, "long words here " * 3000, "en", "a", 48_000), (10, "The Same TEXT as that one", "en", "c", 25), (11, "the same text as that one", "en", "c", 25),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    from comparing import assert_equal, database

    assert_equal(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.ORACLES[name])


def test_row_by_row_operators_keep_odd_rows(odd, none):
    for operator in (bpe_count.token_counts, nbest.encode_documents, pii.find_pii, near_dup.fingerprints, doc_prints.fingerprints, quality.statistics, mixing.leaves):
        assert operator(odd).count() == len(ODD)
        assert operator(none).count() == 0


# secrets


def secrets(text):
    kinds = {
        "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, good)) in enumerate(kinds.items()) for m in re.finditer(p, text) if good(m)]
    return [(s, e, kind) for s, _, kind, e in sorted(found)]


def test_secrets_equal_brute_force(spark):
    rnd = random.Random(5)
    bits = ["token", "Secret", "api_key", "apikey", '"', "'", ":", "=", " ", "abc12", "deadbeef" * 3, "AKIA", "ABCDEF0123456789", "é", "\n"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(12))) for _ in range(400)]
    found, _ = secret_ledger.scan_incremental(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.path: [(s.start, s.end, s.kind) for s in r.spans] for r in found.collect()}
    assert got == {i: secrets(t) for i, t in enumerate(texts)}


def test_ledger_scans_unseen_pairs_only(spark, odd, none):
    first = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, None)], "doc_id long, text string")
    found, ledger = secret_ledger.scan_incremental(first)
    assert {r.path: len(r.spans) for r in found.collect()} == {1: 1, 2: 1, 3: 0}
    assert ledger.count() == 2
    more = first.unionByName(spark.createDataFrame([(4, "token=abcdef2")], first.schema))
    found, ledger = secret_ledger.scan_incremental(more, ledger)
    assert {r.path: len(r.spans) for r in found.collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    assert ledger.count() == 3  # one new blob
    newer = (*secret_ledger.RULES[:2], secret_ledger.Rule("hex", 2, r"[0-9a-f]{30,}", 0, 30))
    new = secret_ledger.scan(more, ledger, newer).collect()
    assert [r.scanned for r in new] == [["hex@2"]] * 3
    found, _ = secret_ledger.scan_incremental(odd)
    assert sorted((r.path or 0, len(r.spans)) for r in found.filter("size(spans) > 0").collect()) == [(7, 2)]
    assert secret_ledger.scan_incremental(none)[0].count() == 0


def test_findings_are_of_the_given_rule_versions(spark):
    docs = spark.createDataFrame([(1, "deadbeef" * 3), (2, "deadbeef" * 4)], "doc_id long, text string")
    _, ledger = secret_ledger.scan_incremental(docs)
    newer = (*secret_ledger.RULES[:2], secret_ledger.Rule("hex", 2, r"[0-9a-f]{30,}", 0, 30))
    found, ledger = secret_ledger.scan_incremental(docs, ledger, newer)
    assert {r.path: [(s.kind, s.end) for s in r.spans] for r in found.collect()} == {1: [], 2: [("hex", 32)]}
    old = secret_ledger.findings(docs, ledger)
    assert {r.path: [(s.kind, s.end) for s in r.spans] for r in old.collect()} == {1: [("hex", 24)], 2: [("hex", 32)]}


# quality


def base_rules(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_statistics_equal_brute_force(spark, docs, odd):
    rnd = random.Random(2)
    made = [(1000 + i, " ".join(rnd.choices(["a", "b", "c", "\n", "d|"], k=rnd.randrange(40)))) for i in range(200)]
    more = spark.createDataFrame(made, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in quality.statistics(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(texts[r.doc_id])
    assert quality.quality(odd).count() == len(ODD)


def test_chi_square():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_cdf(3.84146, 1) == pytest.approx(0.95, abs=1e-5)


@pytest.mark.parametrize("place_bits", [20, 4, 62])
def test_repeated_words_where_places_or_hashes_run_out(spark, place_bits):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices("abc", k=rnd.randrange(40))) for _ in range(150)]
    hashes = [[hash(tuple(t.split()[i : i + 3])) for i in range(len(t.split()) - 2)] for t in texts]
    rows = spark.createDataFrame(list(enumerate(hashes)), "doc_id long, h array<long>")
    got = {r.doc_id: r.n for r in quality.repeated_words(rows, "h", "n", place_bits).collect()}
    assert got == {i: base_rules(t)[4] for i, t in enumerate(texts)}


GRID_SCHEMA = "lang string, source string, n_words long, doc_id long, " + ", ".join(f"{f} long" for f in quality.FEATURES)


def vectors(spark, values, n_words=100, source="s"):
    rows = [("en", source, n_words, i, *(int(round(float(x) * 1000)) for x in v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def fitted(rows):
    named = rows.join(quality.units(rows), ["lang", "source"]).filter("unit is not null").select("unit", "n_words", "doc_id", *quality.FEATURES)
    z = quality.standardized(named, quality.scales(named))
    return z, quality.estimates(z)


def distances(rows):
    z, estimate = fitted(rows)
    return {r.doc_id: r.d for r in z.join(estimate, "unit").withColumn("d", quality._distance()).collect()}


def test_outliers_are_rejected_though_they_are_many(spark, none):
    rng = np.random.default_rng(1)
    limit = quality.chi2_quantile(0.999, 5)
    values = np.concatenate([rng.normal(size=(700, 5)), rng.normal(8, 0.1, (300, 5))])
    out = distances(vectors(spark, values))
    assert all(out[i] > limit for i in range(700, 1000)) and sum(out[i] > limit for i in range(700)) < 15
    assert quality.quality(none).count() == 0


def brute_mcd(x, starts=400):
    """Least determinant of the covariance of half the rows, over many random starts run to the end."""
    rng, h, best = np.random.default_rng(0), int(np.ceil(len(x) * quality.SHARE)), np.inf
    for _ in range(starts):
        half = rng.choice(len(x), x.shape[1] + 2, replace=False)
        for _ in range(60):
            mean, cov = x[half].mean(0), np.cov(x[half].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(half):
                break
            half = new
        best = min(best, np.linalg.slogdet(np.cov(x[half].T, bias=True))[1])
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_determinant_is_near_the_least_of_many_random_starts(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    mixing_ = rng.normal(size=(5, 5))
    values = np.concatenate([rng.normal(size=(60, 5)) @ mixing_, rng.normal(4, 1, (20, 5)) @ mixing_])
    raw = []
    estimate = quality._estimate

    def noted(rows, keys, factor, name):
        out = estimate(rows, keys, factor, name)
        if keys == ("unit",) and name == "step":
            raw.append(out.first().log_det)
        return out

    monkeypatch.setattr(quality, "_estimate", noted)
    z, _ = fitted(vectors(spark, values))
    x = np.array([[r[f] for f in quality.FEATURES] for r in z.orderBy("doc_id").collect()])
    got = 2 * min(raw) - 5 * np.log(quality.consistency(quality.SHARE, 5))
    assert got <= brute_mcd(x) + 0.7


def test_features_without_spread_are_left_out(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(200, 5))
    values[:, 2:4] = 0
    values[:20, 2] = 1
    values[-1] = 9
    out = distances(vectors(spark, values))
    assert out[199] > 50 and np.median([*out.values()]) < 4
    assert not distances(vectors(spark, np.zeros((80, 5)))) or max(distances(vectors(spark, np.zeros((80, 5)))).values()) == 0


def test_small_sources_are_estimated_together(spark):
    rows = vectors(spark, np.zeros((30, 5)), source="a").unionByName(vectors(spark, np.zeros((30, 5)), source="b")).unionByName(vectors(spark, np.zeros((60, 5)), source="c"))
    rows = rows.unionByName(vectors(spark, np.zeros((5, 5)), source="d").withColumn("lang", F.lit("fr")))
    got = {(r.lang, r.source): r.unit for r in quality.units(rows).collect()}
    assert got["en", "a"] == got["en", "b"] != got["en", "c"] and got["fr", "d"] is None


# mixing


def test_shortage_goes_to_siblings_first(spark):
    sizes = spark.createDataFrame([("core", "en", "a", 10), ("core", "en", "b", 1000), ("core", "de", "c", 1000), ("web", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    even = {"domain": {}, "lang": {}, "source": {}}
    got = {r.source: r.share for r in mixing.budgets(sizes, even, 300, 1).collect()}
    assert got == {"a": 10, "b": 216, "c": 226, "d": 451} and sum(got.values()) == 903
    all_of_it = {r.source: r.share for r in mixing.budgets(sizes, even, 1000, 1).collect()}
    assert all_of_it == {"a": 10, "b": 1000, "c": 1000, "d": 1000}


def test_mixing_odd_rows(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == len(ODD) and all(r.copies >= 0 for r in rows)
    assert mixing.mixed(none).count() == 0
    some = mixing.select_mixed(odd, budget=500)
    assert some.columns == odd.columns and some.count() < len(ODD)
    assert mixing.select_mixed(odd, budget=1000).count() == len(ODD)


def test_equal_rows_are_taken_up_to_the_budget(spark):
    rows = [(None, "one two three four", "en", "a")] * 90 + [(1, "five six", "en", "a"), (2, "", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = mixing.mixed(docs, budget=500, epochs=1).collect()  # 181 of 362 tokens
    used = sum(r.copies * r.n_tokens for r in got)
    assert 181 <= used < 181 + 4
    assert len(got) == 92 and len(mixing.mixed(docs, budget=1000, epochs=1).filter("copies = 1").collect()) == 92


# personal data


def base_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_equals_brute_force(docs):
    rnd = random.Random(3)
    odd = ["".join(rnd.choice("0123456789.@+ -()ab%é") for _ in range(rnd.randrange(80))) for _ in range(5000)]
    for text in [*odd, *(r.text for r in docs.collect()), "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "0" * 5000 + ".1.1.1", "9" * 6000 + ".1.1.1 1.1.1." + "1" * 5000, "1 " * 9000]:
        assert [s for s in pii.spans(text) if s[1] < 4] == base_pii(text)


def test_pii_added_kinds_and_redaction():
    text = "see ssh://bob:pw@host.example.org/x, IBAN: DE89370400440532013000 and http://example.org/a"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.spans(text) if k > 3] == [("url", "ssh://bob:pw@host.example.org/x,"), ("account", "DE89370400440532013000")]
    assert pii.redacted(text, pii.spans(text)) == "see <URL> IBAN: <ACCOUNT> and http://example.org/a"
    assert pii.redacted("a 1.2.3.4 b", pii.spans("a 1.2.3.4 b")) == "a <IP> b"


def test_redact_keeps_columns(odd):
    out = pii.redact(odd)
    assert out.schema == odd.schema and out.count() == len(ODD)
    assert out.filter("doc_id = 1").first().text is None


# near duplicates


def connected(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius):
            parent[find(i)] = find(i + 1 + int(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("masks, radius", [(hamming.covering_masks(4), 4), (hamming.block_masks(3), 3)])
def test_masks_catch_every_pair(masks, radius):
    rnd = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("block", [8, 4096])
def test_links_connect_what_is_near(spark, block):
    rng = np.random.default_rng(4)
    heart = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = lambda: np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4)).tolist())))
    prints = np.unique(np.array([h ^ flips() for h in heart for _ in range(60)] + [*rng.integers(0, 1 << 63, 100, dtype=np.uint64)], np.uint64))
    signed = prints.view(np.int64).tolist()
    df = spark.createDataFrame([(fp, i % 3 + 1) for i, fp in enumerate(signed)], "fp long, n long")
    links = components(hamming.hamming_links(df, 4, hamming.covering_masks(4), block))
    got = {r.a: r.b for r in links.collect()}
    least = {}
    roots = connected(prints, 4)
    for fp, r in zip(signed, roots, strict=True):
        least[r] = min(fp, least.get(r, fp))
    assert {fp: least[r] for fp, r in zip(signed, roots, strict=True) if least[r] != fp} == got
    counts = {r.fp: r.near for r in hamming.hamming_counts(df, 3, hamming.block_masks(3), block).collect()}
    rows = np.arange(len(prints)) % 3 + 1
    want = [int(rows[(np.bitwise_count(prints ^ p) <= 3) & (prints != p)].sum()) for p in prints]
    assert counts == {fp: n for fp, n in zip(signed, want, strict=True) if n}


def test_more_rows_keep_more_blocks():
    assert hamming.kept_blocks(3, 1000) == 2
    for rows in (10**8, 10**10):
        kept = hamming.kept_blocks(3, rows)
        assert all(2 ** m.bit_count() > rows / 2 for m in hamming.block_masks(3, kept))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(100, i) for i in range(101, 160)]
    got = {r.a: r.b for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    text = "The quick\tBROWN fox  jumps"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"the quick brown fox", b"quick brown fox jumps")]
    assert near_dup.shingle_hashes(text).tolist() == hashes
    assert near_dup.simhash(text) == hashes[0] & hashes[1]
    assert near_dup.simhash("one two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert near_dup.simhash(" ") == 0


def test_near_duplicates_odd_rows(odd, none):
    rows = {(r.doc_id, r.fp): r.component_id for r in near_dup.near_duplicates(odd).collect()}
    assert {v for (i, _), v in rows.items() if i in (1, 2, 3)} == {1}
    assert rows[next(k for k in rows if k[0] == 11)] == 10
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]
    nameless = odd.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))
    assert near_dup.keep_one(nameless).count() == 1


def test_components_through_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "fingerprints", lambda docs: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    far = 0x0FF0FF00
    rows = [(7, 0), (None, 0b1111), (3, 0b11111111), (None, far << 20), (None, far << 20), (9, -1), (2, 0x7F00FF << 32), (9, 0x7F00FF << 32)]
    docs = spark.createDataFrame([(i, str(fp)) for i, fp in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in near_dup.near_duplicates(docs).collect()), key=str)
    want = [(i, fp, c) for (i, fp), c in zip(rows, [3, 3, 3, None, None, 2, 2, 2], strict=True)]
    assert got == sorted(want, key=str)


def test_keep_one_keeps_different_texts_of_an_id(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven eight nine " * 3)
    rows = [(5, one, "a"), (5, two, "b"), (5, two, "c"), (6, one, "d"), (7, two, "e"), (None, one, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(((r.doc_id, r.text) for r in near_dup.keep_one(d).collect()), key=str) for d in (docs, docs.orderBy(F.desc("source")))]
    assert kept[0] == sorted([(5, one), (5, two)], key=str)
    assert kept[0] == kept[1]


# tokens


def test_token_counts_equal_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe_count.TOKENIZER))
    rnd = random.Random(1)
    texts = [r.text for r in docs.collect()] + ["", "<|endoftext|> a<|endoftext|>", "  a  b\n\n c\t\td  ", "don't we'll I'LL", "\x1c\x1d a", "éé 日本語 😀!!  ", "!" * 3000]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(1, 0x3000), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(500)]
    count = bpe_count.counter(bpe_count.TOKENIZER).count
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def all_segmentations(m, text):
    if not text:
        return [(0.0, ())]
    out = []
    pieces = {sp: i for sp, i in m.by_piece.items() if text.startswith(sp)}
    options = [(sp, m.score[i], (i,)) for sp, i in pieces.items()]
    if text[0] not in pieces:
        options.append((text[0], m.unknown, tuple(m.byte[b] for b in text[0].encode())))
    for sp, s, ids in options:
        out += [(s + t, ids + rest) for t, rest in all_segmentations(m, text[len(sp) :])]
    return out


def test_nbest_equals_all_segmentations():
    m = nbest.model(nbest.MODEL)
    m.by_piece = {bytes(m.surface[i]).decode(): i for i in m.score}
    for text in ("hello", "ab cd", "the  x", "tion\nere", "日x²."):
        brute = sorted((s for s, _ in all_segmentations(m, nbest.META + text.replace(" ", nbest.META))), reverse=True)[:4]
        got = m.nbest(text, 4)
        assert [s for s, _ in got] == pytest.approx(brute)
        assert all(m.decode(ids) == text for _, ids in got)


def test_second_segmentation_of_tied_chunks(spark):
    m = nbest.model(nbest.MODEL)
    m.by_piece = {bytes(m.surface[i]).decode(): i for i in m.score}
    texts = ["ingered", "x.%%%", "$$$", "ingered %%%", "the ingered"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ties = 0
    for r in nbest.encode_documents(docs).collect():
        every = sorted(all_segmentations(m, nbest.META + texts[r.doc_id].replace(" ", nbest.META)), key=lambda x: -x[0])
        assert [r.best_score, r.second_score] == pytest.approx([s for s, _ in every[:2]])
        of = {ids: s for s, ids in every}
        assert [of[tuple(r.ids)], of[tuple(r.second_ids)]] == pytest.approx([r.best_score, r.second_score])
        assert r.ids != r.second_ids
        ties += r.best_score - r.second_score < 1e-9
    assert ties >= 1


def test_chunks_searched_together_equal_the_heap(docs, monkeypatch):
    one, many = (nbest.Model(public_tokenizers.path(nbest.MODEL)) for _ in range(2))
    rnd = random.Random(4)
    texts = [r.text for r in docs.limit(80).collect()] + ["ingered x.%%% $$$", "a\nb\n\n c", "日本 x²!!", "x" * 100, "", "😀\n😀"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(1, 0x3000), rnd.randrange(0x10000, 0x1FFFF), 10, 32])) for _ in range(60)) for _ in range(100)]
    monkeypatch.setattr(nbest, "TOGETHER", 1000)
    chunks = [*map(many.chunks, texts)]
    heap = Counter()
    search = many.segmentations
    many.segmentations = lambda chunk, n: (heap.update([chunk]), search(chunk, n))[1]
    many.learn(chunks)
    every = set().union(*chunks)
    assert not heap and len(many) > 0.6 * len(every) and max(map(len, many)) <= nbest.CACHED_CHARS
    for chunk in every:
        assert many[chunk] == one[chunk], chunk
    assert heap["x" * 100] == 0 and heap[nbest.META + "x" * 100] == 1


def test_weights_are_log_probabilities_in_the_order_of_the_merges():
    m = nbest.model(nbest.MODEL)
    assert sum(np.exp(s) for s in m.score.values()) == pytest.approx(1)
    assert sorted(m.score, key=lambda i: -m.score[i]) == sorted(m.score, key=lambda i: (-m.sp.get_score(i), i))


def test_library_pieces_by_chunk_and_agreement(spark, docs):
    m = nbest.model(nbest.MODEL)
    odd = [" lead", "two  blanks", "a\nb", "x" * 500, "日本 x²!!", "trail  "]
    texts = [r.text for r in docs.limit(40).collect()] + odd
    for text in texts:
        assert [i for c in m.chunks(text) for i in m.merged(c)] == m.sp.encode(text)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.ids for r in nbest.encode_by_merges(rows).orderBy("doc_id").collect()] == [m.sp.encode(t) for t in texts]
    encoded = nbest.encode_documents(rows)
    for r in encoded.collect():
        chunks = m.chunks(texts[r.doc_id])
        assert (r.n_chunks, r.n_merged) == (len(chunks), sum(list(next(m.segmentations(c, 1))[1]) == m.merged(c) for c in chunks))
    total = encoded.agg(F.sum("n_merged") / F.sum("n_chunks")).first()[0]
    assert total > 0.8




def test_encoding_round_trip(odd):
    encoded = nbest.encode_documents(odd)
    back = {(r.doc_id, r.text) for r in nbest.decode_documents(encoded).collect()}
    assert back == {(r[0], (r[1] or "").replace(nbest.META, " ")) for r in ODD}
    rows = nbest.digest(encoded).collect()
    assert all(r.round_trip for r in rows)
    assert all(r.second_score is None or r.second_score <= r.best_score for r in rows)


def test_digest_tells_both_segmentations(odd):
    encoded = nbest.encode_documents(odd)
    sha = lambda ids: None if ids is None else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    key = lambda x: str(x)
    want = sorted(((r.doc_id, sha(r.ids), sha(r.second_ids)) for r in encoded.collect()), key=key)
    assert sorted(((r.doc_id, r.ids_sha256, r.second_sha256) for r in nbest.digest(encoded).collect()), key=key) == want
    assert any(s is None for _, _, s in want) and any(s for _, _, s in want)


# fingerprints


def test_next_and_edited_texts(spark, docs):
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = doc_prints.with_next(docs, doc_prints._edited, doc_prints.SCHEMA, 1 << 16).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
    same = doc_prints.fingerprints(docs).join(docs, "doc_id").groupBy("text").agg(F.count_distinct("fp").alias("n"))
    assert same.filter("n > 1").count() == 0
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_fingerprint_odd_rows(odd, none):
    assert doc_prints.with_next(odd, doc_prints._edited, doc_prints.SCHEMA).count() == len(ODD)
    assert doc_prints.with_next(none, doc_prints._edited, doc_prints.SCHEMA).count() == 0
    alone = doc_prints.with_next(odd.filter("doc_id = 4"), doc_prints._edited, doc_prints.SCHEMA).collect()
    assert [(r.n_chars, r.edited_sha256) for r in alone] == [(4, hashlib.sha256(b"wowo").hexdigest())]


def test_near_fingerprints_equal_brute_force(spark, docs):
    prints = doc_prints.fingerprints(docs)
    got = {r.doc_id: (r.class_id, r.n_near) for r in prints.join(doc_prints.near(prints), "fp").collect()}
    rows = sorted((r.doc_id, r.fp) for r in prints.collect())
    fps = np.array([f for _, f in rows], np.int64).view(np.uint64)
    roots = connected(fps, doc_prints.RADIUS)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least.setdefault(r, i)
    n_near = [int((np.bitwise_count(fps ^ f) <= doc_prints.RADIUS).sum()) - 1 for f in fps]
    assert got == {i: (least[r], n) for (i, _), r, n in zip(rows, roots, n_near, strict=True)}
    assert any(n_near)


def test_near_through_rows_without_id(spark, none):
    prints = spark.createDataFrame([(1, 0x0F), (None, 0x7F), (2, 0x3FF), (2, 0x3FF)], "doc_id long, fp long")
    got = sorted((r.fp, r.class_id, r.n_near) for r in doc_prints.near(prints).collect())
    assert got == [(0x0F, 1, 1), (0x7F, 1, 3), (0x3FF, 1, 2)]
    assert doc_prints.near(prints.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_the_blocks(monkeypatch):
    texts = [b"one TWO three " * 9, b"", b"x" * 40, b" two "]
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = hashing.word_hashes(data, off, hashing.NON_BLANK)
    assert len(set(whole[0].tolist())) == 4
    for block in (1, 7, 16):
        monkeypatch.setattr(hashing, "BLOCK", block)
        again = hashing.word_hashes(data, off, hashing.NON_BLANK)
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))


# all operators


def clashing(spark):
    """Documents with columns whose names differ in case only."""
    rows = [(i, f"some words here number {i} and more " * 4, "en", "a", 40, "other", -1) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, x string, y long").toDF("doc_id", "text", "lang", "source", "n_chars", "Text", "DOC_ID")


def test_names_that_clash_by_case(spark):
    docs = clashing(spark)
    labels = docs.select(F.col("n_chars").alias("toxic"), F.col("n_chars").alias("Toxic"))
    for operator in (bpe_count.token_counts, nbest.encode_documents, pii.find_pii, near_dup.near_duplicates, doc_prints.fingerprints, quality.quality, mixing.mixed, lambda d: secret_ledger.scan_incremental(d)[0], lambda d: language.predict(d, language.train(d)), lambda d: toxicity.score(d, None)):
        assert operator(docs).count() == 12
    assert doc_prints.with_next(docs, doc_prints._edited, doc_prints.SCHEMA).count() == 12
    for operator in (pii.redact, lambda d: mixing.select_mixed(d, budget=1000), lambda d: language.keep_known(d, None, 0.0)):
        out = operator(docs)
        assert out.columns == docs.columns and out.count() == 12
        assert {r[0] for r in out.collect()} == set(range(12)) and {r[6] for r in out.collect()} == {-1}
    assert near_dup.keep_one(docs).columns == docs.columns
    assert labels.columns == ["toxic", "Toxic"]


def test_shared_folder_is_needed_beyond_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local[4]"
    assert common.shared_dir(Session()).startswith("file:")


def test_written_tables_go_with_their_scope(spark):
    from pathlib import Path

    at = lambda df: Path(df._scrollsift_path.removeprefix("file://"))
    with common.scratch(spark) as keep:
        one, two = (common.written(spark.range(n), "t") for n in (1, 2))
        keep.append(two)
        assert at(one).exists()
    assert not at(one).exists() and at(two).exists() and two.count() == 2
    common.discard(two)
    assert not at(two).exists()


def test_pieces_remember_frequent_chunks_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(nbest, "CACHE", 50)
    m, searched = nbest.Model(public_tokenizers.path(nbest.MODEL)), Counter()
    search = m.segmentations
    m.segmentations = lambda chunk, n: (searched.update([chunk]), search(chunk, n))[1]
    want = m["often"]
    for i in range(1000):
        assert m["often"] == want and m[f"rare{i}"]
        assert len(m) <= 50
    assert searched["often"] == 1 and len(m.older) <= 50
    monkeypatch.setattr(nbest, "CACHE", 10_000)
    tracemalloc.start()
    for i in range(5000):
        m[f"x{i}y"]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 280 * 5000, held / 5000


def test_seen_share_takes_steps_and_little_memory():
    net, rng = language.ByteNet.fresh(["a", "b"]), random.Random(5)
    net.seen = np.random.default_rng(5).random(65536) < 0.5
    texts = [None, "", "a", "12 3"] + ["".join(rng.choices("ab cDé漢 1\n", k=rng.randint(0, 300))) for _ in range(40)]
    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    want = []
    for t in texts:
        raw = (t or "").encode()
        pairs = [int(x) for x in language.byte_pairs(np.frombuffer(raw, np.uint8))] if raw else []
        both = [x for x in pairs if language.LETTERS[x]]
        want.append(sum(bool(net.seen[x]) for x in both) / len(both) if both else 1.0)
    assert language.seen_share(net, part).tolist() == want
    large = pa.RecordBatch.from_arrays([pa.array(["x y é z " * 500_000])], names=["text"])  # 4.5 MB
    tracemalloc.start()
    language.seen_share(net, large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, peak
    assert all(language.seen_share(net, part, step=s).tolist() == want for s in (1, 2, 7, 64))


def test_very_long_text(spark):
    text = "long text with an address a@b.example and token=abcdef1 " * 60_000  # 3 MB
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, "short", "en", "a")], "doc_id long, text string, lang string, source string")
    assert len(pii.spans(text)) == 60_000
    assert secret_ledger.scan_incremental(docs)[0].selectExpr("max(size(spans))").first()[0] == 60_000
    assert quality.statistics(docs).agg(F.max("n_repeat_words")).first()[0] == 9 * 60_000
    rows = {r.doc_id: r for r in doc_prints.with_next(docs, doc_prints._edited, doc_prints.SCHEMA).collect()}
    assert rows[1].n_chars == len(text)
    assert near_dup.near_duplicates(docs).count() == 2
