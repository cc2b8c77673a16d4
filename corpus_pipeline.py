"""Corpus pipeline: five stages over documents, each by one training-data operator.

language      rejects documents of no known language
near_dup      keeps one document of each group of near copies
pii           replaces personal data by its kind
mixing        selects documents by the weights of their domain, language and source
pieces        encodes the texts and checks that they decode again

Each stage gets what the one before it kept; all but the last return the columns of
documents. Texts change in the PII stage only. Null and empty texts have no letter and go
in the first stage, very long ones are taken whole. Repeated rows are copies: one stays.
Rows without doc_id are documents like others but never learned from. Ties are settled as
each operator states. Extra columns stay up to the last stage, whatever their names; the
stages between are written, so there no two names may differ in case only. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrollsift.llm import language, mixing, nbest, near_dup, pii
from scrollsift.llm.common import discard, documents, named, scratch, written

#: Documents whose best language has a lesser mean probability are rejected, as a part of
#: the way from even odds to certainty: 0.3 with four languages.
LEAST_SCORE = 1 / 15
#: Documents with a lesser share of letter pairs that the network learned from are rejected.
LEAST_SEEN = 0.5
#: Tokens wanted, as parts of a thousand of what the stages before have left.
BUDGET = 900


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language.train(named(docs, "doc_id", "text", "lang").filter(~language.held_out()))
    even = 1 / len(net.classes) if net else 0.0
    return language.keep_known(docs, net, even + LEAST_SCORE * (1 - even), LEAST_SEEN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_mixed(docs, budget=BUDGET)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest.digest(nbest.encode_documents(docs))


STAGES = [
    ("language", identify_language),
    ("near_dup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express a trained network or a piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's tables go as soon as the next stage has read them."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
