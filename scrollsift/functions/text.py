"""Scalar expressions over lines and texts; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def lines(text: Column) -> Column:
    """Lines of a text: cut at newlines, one carriage return stripped, no empty last line."""
    parts = F.split(text, "\n")
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(F.coalesce(cut, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"\r\z", ""))


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def character_set(text: Column) -> Column:
    return F.array_distinct(characters(text))


def shannon_entropy(text: Column) -> Column:
    """Entropy of the characters, their shares taken of the length in bytes.

    Sorted characters stand in runs, and the lengths of the runs are the counts.
    """
    runs = F.regexp_extract_all(F.array_join(F.sort_array(characters(text)), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    size = F.octet_length(text).cast("double")

    def bits(acc: Column, run: Column) -> Column:
        p = F.length(run) / size
        return acc - p * F.log2(p)

    return F.when(text == "", F.lit(0.0)).otherwise(F.aggregate(runs, F.lit(0.0), bits))


def change_score(text: Column, other: Column) -> Column:
    """0 for equal texts, else 1 less the Jaccard likeness of their character sets."""
    return F.when(text == other, F.lit(0.0)).otherwise(1 - jaccard(character_set(text), character_set(other)))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets: what both have over what either has."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def normalize(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Replace (pattern, replacement) pairs one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def technical_score(text: Column, patterns: Iterable[tuple[str, float]], most: float) -> Column:
    total = reduce(lambda s, r: s + F.regexp_count(text, F.lit(r[0])) * F.lit(r[1]), patterns, F.lit(0.0))
    return F.least(total / most, F.lit(1.0))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (start, end, value) in characters.

    The parts between the matches give their offsets. A text without a match is not split.
    """
    none = F.array().cast(f"array<{SPAN}>")
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc.out, span).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pieces, zero, step, lambda acc: acc.out)).otherwise(none)


def context(text: Column, start: Column, end: Column, window: Column) -> Column:
    """Characters around a span, clamped to the text."""
    first = F.greatest(start - window, F.lit(0))
    return F.substring(text, first + 1, end + window - first)


def parse_port(value: Column) -> Column:
    """The number before a slash if it is a port, else null."""
    first = F.split_part(value, F.lit("/"), F.lit(1))
    port = F.when(first.rlike("^[0-9]{1,5}$"), first.cast("int"))
    return F.when(port <= 65535, port)


def parse_service(value: Column) -> Column:
    """(name, version) of exactly two parts, else null."""
    parts = F.split(value, "/")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("name"), parts[1].alias("version")))


def format_size(size: Column) -> Column:
    """Steps of 1024 with two decimals, B to TB."""
    out = F.format_string("%.2f TB", F.bround(size / float(1024**4), 2))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < float(1024 ** (power + 1)), F.format_string(f"%.2f {unit}", F.bround(size / float(1024**power), 2))).otherwise(out)
    return out


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def snippet(text: Column) -> Column:
    return preview(text, 200)


def content_hash(text: Column) -> Column:
    """First half of the SHA-256 of a content."""
    return F.left(F.sha2(text, 256), F.lit(32))


def shard_path(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def flush_seconds(text: Column) -> Column:
    """'500ms', '5s' or a bare number of seconds; anything else is 5 seconds."""
    number = lambda p: F.regexp_extract(text, p, 1).cast("double")
    return (
        F.when(text.rlike(r"^\d+ms$"), number(r"^(\d+)ms$") / 1000)
        .when(text.rlike(r"^\d+s?$"), number(r"^(\d+)s?$"))
        .otherwise(F.lit(5.0))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def session_name(started: Column) -> Column:
    return F.concat(F.lit("session_"), F.date_format(started, "yyyyMMdd_HHmmss"))


def status_label(status: Column) -> Column:
    return F.initcap(status)
