"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, schemes, plus signs,
digits and identifier cues. From each anchor a local parser expands to the left
and right, settles the boundaries of the email, address or account there and
validates it. Kinds: email, ip, card and phone, and besides them url (an address
that carries a user) and account (an identifier that follows a cue).

Matches of one kind don't overlap, leftmost first; one that fails its validation
is dropped without another try. Null texts count as empty: no spans. Rows are kept
one for one, repeated or not; extra columns stay untouched where documents are redacted,
whatever their names. Texts are taken whole, one at a time, and runs of digits may have
any length. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import count_kind, documents, named, numbered, slices

#: The listed kinds, then the added ones; spans that start together stand in this order.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Words before an account or identity number.
CUES = ("account", "acct", "iban", "passport", "ssn", "tax id", "user id", "customer id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = re.compile(r"(?:ftp|ftps|http|https|ldap|sftp|smb|ssh)\Z")
USER_AT_HOST = re.compile(r"[A-Za-z0-9._%~+-]+(?::[^\s/@]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+[^\s\"'<>]*")
IDENTIFIER = re.compile(r"(?: (?:no|number|nr))?\.?[ ]?[:=#]?[ ]?([A-Z]{0,4}[0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        found.add_word(word, (word if not word.isdigit() else "0", len(word)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _addresses(text: str, run: re.Match) -> Iterator[tuple[int, int]]:
    """Each four dotted numbers of a run, one after the other."""
    at, groups = run.start(), run[0].split(".")
    for i in range(0, len(groups) - 3, 4):
        four = groups[i : i + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(g) <= 3 and int(g or 0) <= 255 for g in (f.lstrip("0") for f in four)):
            yield at, end
        at = end + 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all personal data, in order."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor == "0":
            if at >= ip_end:
                run = GROUPS.match(text, at)
                ip_end = run.end()
                out += ((s, 1, e) for s, e in _addresses(text, run))
            if at >= card_end and (run := DIGITS.match(text, at)):
                card_end = run.end()
                digits = run[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
        elif anchor == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (domain := DOMAIN.match(text, at + 1)):
                email_end = domain.end()
                out.append((start, 0, email_end))
        elif anchor == "+":
            if at >= phone_end and (run := DIALLED.match(text, at)):
                phone_end = run.end()
                if 9 <= sum(map(str.isdigit, run[0])) <= 15:
                    out.append((at, 3, phone_end))
        elif anchor == "://":
            scheme = SCHEME.search(text[max(0, at - 5) : at])
            if scheme and (rest := USER_AT_HOST.match(text, last + 1)):
                start = at - len(scheme[0])
                if start >= url_end and not text[max(0, start - 1) : start].isalnum():
                    url_end = rest.end()
                    out.append((start, 4, url_end))
        elif at >= account_end and not text[max(0, at - 1) : at].isalnum():
            found = IDENTIFIER.match(text, last + 1)
            if found and sum(map(str.isdigit, found[1])) >= 6:
                account_end = found.end(1)
                out.append((found.start(1), 5, account_end))
    return sorted(out)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of touching spans replaced by the first one's <KIND>."""
    parts, done = [], 0
    for start, kind, end in found:
        if start >= done:
            parts += (text[done:start], f"<{KINDS[kind].upper()}>")
        done = max(done, end)
    return "".join((*parts, text[done:]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, spans): code points, end exclusive. Without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t.as_py() or "")] for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """Documents with their personal data replaced; n_chars follows the text. Null texts stay null."""
    rows, place = numbered(docs)
    at, n_chars = place["text"], place.get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, col=at):
                texts = [None if (t := x.as_py()) is None else redacted(t, spans(t)) for x in part.column(at)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {at: pa.array(texts, part.schema.field(at).type)}
                if n_chars:
                    old = columns[n_chars].to_pylist()
                    columns[n_chars] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], columns[n_chars].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    counts = [count_kind("spans", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: The same kinds for SQL: pattern, group that is the span, and what makes a match (value v, character before it p) good.
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST({_DIGITS}[-j] AS INT) "
    f"ELSE CAST({_DIGITS}[-j] AS INT) * 2 - CASE WHEN CAST({_DIGITS}[-j] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_FORMS = "|".join(f for c in CUES for f in (c, c.upper(), c.capitalize()))
_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0, "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(x AS BIGINT) > 255)) = 0"),
    "card": (r"[0-9](?:[ -]?[0-9])+", 0, f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0, f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "url": (rf"(?:https|http|ftps|ftp|ldap|sftp|smb|ssh)://{USER_AT_HOST.pattern}", 0, r"NOT regexp_matches(p, '[\p{L}\p{N}]')"),
    "account": (rf"(?:{_FORMS}){IDENTIFIER.pattern.removesuffix('(?![A-Za-z0-9])')}", 1, f"NOT regexp_matches(p, '[\\p{{L}}\\p{{N}}]') AND length({_DIGITS}) >= 6 AND NOT regexp_matches(n, '[A-Za-z0-9]')"),
}


def _kind_sql(rank: int, kind: str) -> str:
    pattern, group, good = _SQL[kind]
    q = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS k, '{kind}' AS kind, s + length(m) - length(v) AS s, s + length(m) AS e FROM (
    SELECT doc_id, m, s, regexp_extract(m, {q}, {group}) AS v, substring(t, s, CASE WHEN s > 0 THEN 1 ELSE 0 END) AS p, substring(t, s + length(m) + 1, 1) AS n FROM (
      SELECT doc_id, t, x[i] AS m, CAST(list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(x[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS s FROM (
        SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, {q}) AS x, string_split_regex(t, {q}) AS b FROM texts))))
  WHERE {good}"""


OP5_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(k, kind) for k, kind in enumerate(KINDS))}),
named AS (SELECT *, kind || ':' || s || ':' || e AS span FROM found),
joined AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)
"""
