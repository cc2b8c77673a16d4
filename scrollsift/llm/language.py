"""Language identification with a byte convolutional network in numpy.

Filters of several widths run over the raw UTF-8 bytes of fixed-length windows;
each filter is max-pooled over the window and a softmax layer turns the pooled
values into language probabilities. A text is cut into windows from its start to
its end; its probabilities are the means over its windows.

Training rows: at most ``max_rows`` texts for each of at most ``max_langs`` languages
(documented bounds), in hash order, with non-null text, language and doc_id, held-out
rows left out; of each all windows. Rows that are equal in doc_id, text and language
count once. Prediction: a null text or one without a letter is ``und`` with score 0, as
is every text if there was nothing to learn from; of equal means the first language in
alphabetical order is taken. Rows are kept one for one, repeated or not; very long texts
are taken whole, some windows at a time; extra columns are ignored or stay, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import documents, hash_sample, named, numbered, packed, slices, written

FOLDS, HELD_OUT = 4, 2
MAX_ROWS, MAX_LANGS = 300, 200
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
UNKNOWN = "und"
#: Bytes in lower case (A-Z only), and pairs of them that both belong to letters or to longer code points.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = ((FOLD >= 97) & (FOLD <= 122)) | (FOLD >= 128)
LETTERS = (LETTER[:, None] & LETTER[None]).ravel()


def byte_pairs(data: np.ndarray) -> np.ndarray:
    """Each byte with the next along the last axis, as one number."""
    low = FOLD[data].astype(np.uint16)
    return (low[..., :-1] << 8) | low[..., 1:]


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows x size bytes, text of each): every byte of every text is in one window.

    The last window of a text is filled with zeros; an empty text has none.
    """
    n = -(-np.diff(off) // size)
    out, first = np.zeros((int(n.sum()), size), np.uint8), np.cumsum(n) - n
    flat = out.ravel()
    for i in np.flatnonzero(n):
        flat[first[i] * size :][: off[i + 1] - off[i]] = data[off[i] : off[i + 1]]
    return out, np.repeat(np.arange(len(n)), n)


@dataclass
class ByteNet:
    """taps[w]: (width, 256, filters), the filters over one-hot bytes; seen: which byte pairs it learned from."""

    classes: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    seen: np.ndarray | None = None

    @classmethod
    def fresh(cls, classes: list[str], seed: int = 7) -> ByteNet:
        rng, total = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(classes, taps, np.zeros(total, np.float32), rng.normal(0, 0.2, (total, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = 3, size: int = 64, rate: float = 0.05, seed: int = 7) -> None:
        """Adagrad on the cross-entropy; only the pooled positions carry gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.taps, self.bias, self.out, self.out_bias]
        past = [np.full_like(p, 1e-3) for p in params]
        for _ in range(passes):
            order = rng.permutation(len(x))
            for s in range(0, len(x), size):
                b, label = x[order[s : s + size]], y[order[s : s + size]]
                rows, grads, tops, wheres = np.arange(len(b)), [np.zeros_like(p) for p in params], [], []
                for t in self.taps:
                    n = b.shape[1] - len(t) + 1
                    act = sum(tap[b[:, k : k + n]] for k, tap in enumerate(t))
                    where = act.argmax(1)
                    wheres.append(where)
                    tops.append(np.take_along_axis(act, where[:, None], 1)[:, 0])
                z = np.concatenate(tops, 1) + self.bias
                hidden = np.maximum(z, 0)
                p = _softmax(hidden @ self.out + self.out_bias)
                p[rows, label] -= 1
                p /= len(b)
                grads[-2], grads[-1] = hidden.T @ p, p.sum(0)
                back = (p @ self.out.T) * (z > 0)
                grads[-3] = back.sum(0)
                for i, (t, where) in enumerate(zip(self.taps, wheres, strict=True)):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(len(t)):
                        np.add.at(grads[i][k], (b[rows[:, None], where + k], np.arange(FILTERS)), g)
                for param, h, g in zip(params, past, grads, strict=True):
                    h += g * g
                    param -= rate * g / np.sqrt(h)

    def pairs(self) -> list[list[tuple[int, np.ndarray]]]:
        """Each width's taps, two at a time, as tables over byte pairs: (offset, table)."""
        out = []
        for t in self.taps:
            tables = [(k, (t[k + 1][:, None] + t[k][None]).reshape(65536, -1)) for k in range(0, len(t) - 1, 2)]
            out.append(tables + ([(len(t) - 1, t[-1])] if len(t) % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, pairs) -> np.ndarray:
        two = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
        tops = []
        for t, tables in zip(self.taps, pairs, strict=True):
            n = x.shape[1] - len(t) + 1
            act = None
            for k, tab in tables:
                part = np.take(tab, (two if len(tab) > 256 else x)[:, k : k + n], axis=0)
                act = part if act is None else np.add(act, part, out=act)
            tops.append(act.max(1))
        hidden = np.maximum(np.concatenate(tops, 1) + self.bias, 0)
        return _softmax(hidden @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS, passes: int = 2) -> ByteNet | None:
    """labelled: (doc_id, text, lang), held-out rows already left out.

    The driver gets the whole texts of at most ``max_rows`` times ``max_langs`` rows.
    """
    known = named(labelled, "doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null and text != ''")
    known = known.withColumn("h", F.xxhash64("text"))
    langs = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).select("lang")
    picked = hash_sample(known.join(F.broadcast(langs), "lang"), "lang", ("doc_id", "h"), max_rows)
    picked = written(picked, "picked")
    found = known.join(F.broadcast(picked), ["lang", "doc_id", "h"])  # bounded by both limits
    rows = found.groupBy("o", "lang").agg(F.min("text").alias("text")).orderBy("o", "lang").toArrow()
    if not rows.num_rows:
        return None
    lang = np.array(rows["lang"].to_pylist())
    classes = sorted(set(lang.tolist()))
    x, text = windows(*packed(rows.combine_chunks().to_batches()[0]))
    net = ByteNet.fresh(classes)
    net.fit(x, np.searchsorted(classes, lang[text]), passes)
    net.seen = np.zeros(65536, bool)
    for s in range(0, len(x), 4096):
        net.seen[byte_pairs(x[s : s + 4096]).ravel()] = True
    return net


def seen_share(net: ByteNet, part: pa.RecordBatch, col: str = "text", step: int = 1 << 18) -> np.ndarray:
    """What share of each text's letter pairs the network learned from; 1 for a text without any.

    Counts ``step`` pairs at a time: the running sums take eight times the bytes of the texts.
    """
    data, off = packed(part, col)
    first, last = off[:-1], np.maximum(off[1:] - 1, off[:-1])  # no pair crosses into the next text
    n, known = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for s in range(0, len(data) - 1, step):
        pairs = byte_pairs(data[s : s + step + 1])
        both = LETTERS[pairs]
        start, stop = (np.clip(x - s, 0, len(pairs)) for x in (first, last))
        for count, marks in ((n, both), (known, both & net.seen[pairs])):
            upto = np.r_[0, np.cumsum(marks)]
            count += upto[stop] - upto[start]
    return np.where(n > 0, known / np.maximum(n, 1), 1.0)


def _scored(net: ByteNet, pairs, part: pa.RecordBatch, known: np.ndarray, col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text of a record batch."""
    x, text = windows(*packed(part, col))
    total = np.zeros((part.num_rows, len(net.classes)))
    for s in range(0, len(x), 64):
        np.add.at(total, text[s : s + 64], net.probabilities(x[s : s + 64], pairs))
    total /= np.maximum(1, np.bincount(text, minlength=part.num_rows))[:, None]
    lang = np.where(known, np.array(net.classes, object)[total.argmax(1)], UNKNOWN)
    return lang, np.minimum(np.where(known, total.max(1), 0.0), 1.0)


def _letters(col: str = "text") -> Column:
    return F.coalesce(F.col(col).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                known = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                lang, score = _scored(net, pairs, part, known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", _letters().alias("letters"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: ByteNet | None, least: float, least_seen: float = 0.0) -> DataFrame:
    """Documents without those of unknown language, of a score below ``least`` or with
    less than ``least_seen`` of their letter pairs learned; all columns stay.

    A network is sure of its languages on bytes it never learned from too, so the
    score alone does not tell a text in another script.
    Without a network there is nothing to reject by but the lack of letters.
    """
    rows, place = numbered(docs)
    rows, at = rows.filter(_letters(place["text"])), place["text"]
    if net is None:
        return rows.toDF(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            for part in slices(batch, 4 << 20, at):
                _, score = _scored(net, pairs, part, np.ones(part.num_rows, bool), at)
                yield part.filter(pa.array((score >= least) & (seen_share(net, part, at) >= least_seen)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = train(named(docs, "doc_id", "text", "lang").filter(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
