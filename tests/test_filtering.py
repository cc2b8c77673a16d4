"""Cases of the three-tier filter with known results."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry, Tier1, Tier2, Tier3
from scrollsift.operators import filtering as L

CAPTURES = "capture_id long, session_id string, ts long, output string"


def captures(spark, *outputs, sessions=None):
    rows = [(i, (sessions or ["s"] * len(outputs))[i], i, o) for i, o in enumerate(outputs)]
    return spark.createDataFrame(rows, CAPTURES)


def kept(spark, registry, *outputs, **more):
    return [(r.capture_id, r.line) for r in L.tier1(L.explode_lines(captures(spark, *outputs, **more)), registry).orderBy("capture_id", "line_no").collect()]


@pytest.mark.parametrize(
    "text, lines",
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n", ["a", "b"]), ("\n", [""]), ("a\n\nb", ["a", "", "b"]), ("a\r\r\n", ["a\r"])],
)
def test_lines(spark, text, lines):
    assert [r.line for r in L.explode_lines(captures(spark, text)).orderBy("line_no").collect()] == lines


def test_tier1_bounds_each_form(spark):
    assert len(kept(spark, Registry(), "test line\n" * 4)) == 3
    two = Registry(tier1=replace(Tier1(), max_occurrences=2))
    assert len(kept(spark, two, "host 10.0.0.1\nhost 10.0.0.2\nhost 10.0.0.3")) == 2


def test_tier1_spans_captures_of_a_session_only(spark):
    assert [c for c, _ in kept(spark, Registry(), "R\nR\nR", "R\nR\nN")] == [0, 0, 0, 1]
    assert len(kept(spark, Registry(), "R\n" * 4, "R\n" * 4, sessions=["a", "b"])) == 6


@pytest.mark.parametrize("text, bits", [("", 0.0), ("a" * 16, 0.0), ("abcdefghijklmnop", 4.0), ("é", 0.5)])
def test_entropy(spark, text, bits):
    row = spark.createDataFrame([(text,)], "t string").select(T.shannon_entropy(F.col("t")).alias("e")).first()
    assert row.e == pytest.approx(bits)


@pytest.mark.parametrize("a, b, score", [("hello", "world", 0.714286), ("x", "x", 0.0), ("abc", "def", 1.0), ("", "ab", 1.0), ("", "", 0.0)])
def test_change(spark, a, b, score):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(F.round(T.change_score(F.col("a"), F.col("b")), 6).alias("s")).first()
    assert row.s == score


@pytest.mark.parametrize("n, p, rank", [(5, 0.0, 1), (5, 0.5, 3), (5, 1.0, 5), (10, 0.8, 9), (1, 0.8, 1)])
def test_percentile_rank(spark, n, p, rank):
    row = spark.createDataFrame([(n,)], "n long").select(L.floor_rank(F.col("n"), p).alias("r")).first()
    assert row.r == rank


def test_tier2_prefers_technical_lines(spark):
    text = "\n".join(["plain line here"] * 4 + ["Found CVE-2024-1234 on 10.0.0.1"])
    out = L.tier2(L.explode_lines(captures(spark, text)), Registry()).collect()
    assert [r.line for r in out] == ["Found CVE-2024-1234 on 10.0.0.1"]
    assert L.tier2(L.explode_lines(captures(spark, "only")), Registry()).count() == 1
    assert L.tier2(L.explode_lines(captures(spark, "")), Registry()).count() == 0


def clusters(spark, text, **tier3):
    registry = Registry(tier3=Tier3(**({"rules": ((r"\d+", "N"),)} | tier3)))
    out = L.tier3(L.explode_lines(captures(spark, text)), registry).collect()
    return sorted((r.pattern, r.kind, r.size, r.representative) for r in out)


def test_tier3_groups_and_splits(spark):
    assert clusters(spark, "Port 1 open\nPort 2 open\nPort 30 open\nother", strategy="first") == [("Port N open", "count", 3, "Port 1 open"), ("other", "singleton", 1, "other")]
    assert [c[1:3] for c in clusters(spark, "a\na\nb\nb\nb", min_size=3)] == [("singleton", 1), ("singleton", 1), ("count", 3)]
    assert sorted(c[2] for c in clusters(spark, "x 1\n" * 5, max_size=2)) == [1, 2, 2]


def test_tier3_representatives(spark):
    text = "v 1\nv 222\nv 345"
    assert clusters(spark, text, strategy="LONGEST")[0][3] == "v 345"
    assert clusters(spark, text, strategy="unknown")[0][3] == "v 345"


def test_synthetic_ten_thousand_lines(spark):
    lines = [f"Found vulnerability CVE-2024-{1000 + i % 100} on 192.168.1.{i % 255}" if i % 10 == 0 else f"Scanning port {i % 65535} on host 192.168.1.{i % 255}" for i in range(10_000)]
    registry = Registry(
        tier1=Tier1(3, ((r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "__IP__"), (r"\b\d{1,5}/(tcp|udp)", "__PORT__"))),
        tier2=Tier2(0.25, 0.25, 0.25, 0.25, 0.7, 10.0, ((r"CVE-\d{4}-\d{4,}", 3.0), (r"v\d+\.\d+", 1.5))),
        tier3=Tier3(2, 100, "highest_entropy", ((r"\b\d+\b", "__NUM__"),)),
    )
    stats = L.filter_stats(captures(spark, "\n".join(lines)), registry).first()
    assert (stats.input_lines, stats.tier1_lines, stats.tier2_lines, stats.clusters) == (10_000, 9_030, 2_744, 29)


def test_empty_capture_counts_nothing(spark):
    r = L.filter_stats(captures(spark, ""), Registry()).first()
    assert (r.input_lines, r.tier1_lines, r.tier2_lines, r.clusters, r.reduction_percent) == (0, 0, 0, 0, 0.0)


def test_weights_warning():
    assert Tier2().warnings() == []
    assert Tier2(entropy=0.9).warnings()
