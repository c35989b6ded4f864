"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over
hashed word features (the word and its byte prefixes, lower-cased), where no
feature counts against the label, and only documents carry labels. With q for
the score of a sentence without any evidence, a fixed background, and one
learned chance c that a document is toxic whatever its sentences say, the law is

    1 - score(document) = (1 - c) * product over sentences of (1 - p) / (1 - q),

a noisy-or in which neutral sentences weigh nothing, so length alone never
makes a text toxic. Training maximises the likelihood of this same law by
proximal gradient steps with an L1 penalty. The sentence scores p then locate
what offends.

Defined results: a null or empty text has no sentence and the score c; a null
id stays null; repeated rows give repeated results; an empty table gives an
empty one; without labelled rows of both classes every score is the share of
label 1 in the sample (0 without any); further columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.labelled import fold, labelled_rows
from tablelog.llm.textbuf import LOWER, slices, span_hashes, text_buffer, tidy, words

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: The logit of a sentence without evidence.
BACKGROUND = -4.0
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b".,;:!?\"'()[]{}*#$%&|<>-_~`", np.uint8)] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?", np.uint8)] = True


@dataclass
class Sentences:
    """Words of a batch with their sentence, sentences with their text and byte range."""

    features: np.ndarray  # [words, 1 + prefixes]; slots of 2 ** BITS, -1 for none
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_texts: int = field(default=0)


def split(column: pa.Array) -> Sentences:
    """A sentence ends with a word that ends in . ! ? or before a line break."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, before = words(data, offsets)
    n = len(starts)
    if not n:
        z = np.zeros(0, np.int64)
        return Sentences(np.zeros((0, 1 + len(PREFIXES)), np.int64), z, z, z, z, len(column))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(n, bool)
    new[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    new[before[:-1][before[:-1] < n]] = True
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    text = np.searchsorted(before, first, "right") - 1
    a, b = starts.copy(), ends.copy()
    for _ in range(4):
        a += (a < b) & _PUNCTUATION[data[np.minimum(a, len(data) - 1)]]
        b -= (a < b) & _PUNCTUATION[data[np.maximum(b - 1, 0)]]
    slots = [np.where(b > a, (span_hashes(data, a, b) >> np.uint64(64 - BITS)).astype(np.int64), -1)]
    for k in PREFIXES:
        long = b - a >= k
        slot = np.full(n, -1, np.int64)
        slot[long] = ((span_hashes(data, a[long], a[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)
        slots.append(slot)
    features = np.stack(slots, 1)
    features[1:][(slots[0][1:] == slots[0][:-1]) & ~new[1:]] = -1  # a word said again at once counts once
    last = np.append(first[1:], n) - 1
    return Sentences(features, sentence, text, starts[first], ends[last], len(column))


@dataclass
class Model:
    weights: np.ndarray  # one per slot, and a 0 for "none" at the end
    chance: float = 0.0  # c of the law, as -log(1 - c)
    constant: float | None = None

    def logits(self, s: Sentences) -> np.ndarray:
        each = self.weights[s.features].sum(1)
        return BACKGROUND + np.bincount(s.sentence, each, len(s.text))

    def score(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """The law for every text, and the score of every sentence."""
        if self.constant is not None:
            return np.full(s.n_texts, self.constant), np.full(len(s.text), self.constant)
        z = self.logits(s)
        evidence = np.bincount(s.text, np.logaddexp(0, z) - np.logaddexp(0, BACKGROUND), s.n_texts)
        return -np.expm1(-self.chance - evidence), 1 / (1 + np.exp(-z))


def fit(texts: list[str], y: np.ndarray, features: int = 4000, least: int = 3, steps: int = 300, l1: float = 2e-4) -> Model:
    """Noisy-or maximum likelihood over the `features` slots most tied to label 1."""
    none = Model(np.zeros((1 << BITS) + 1, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return none
    n, m = len(y), 1 << BITS
    column = pa.array(texts, pa.string())
    parts = list(slices(column, 1 << 20))  # memory follows a slice, not the sample
    pos, neg = np.zeros(m), np.zeros(m)
    for a, b in parts:
        s = split(column.slice(a, b - a))
        slot = s.features.ravel()
        at = np.repeat(s.text[s.sentence], s.features.shape[1])
        pair = np.unique(slot[slot >= 0] * (b - a) + at[slot >= 0])  # distinct (slot, text)
        truth = y[a:b][pair % (b - a)]
        pos += np.bincount(pair // (b - a), truth, m)
        neg += np.bincount(pair // (b - a), 1 - truth, m)
    n1, n0 = y.sum(), n - y.sum()
    tied = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    worth = np.where((pos >= max(least, 0.01 * n1)) & (tied > 1), pos * tied, 0)
    top = np.argsort(-worth)[:features]
    top = top[worth[top] > 0]
    index = np.full(m + 1, -1, np.int64)
    index[top] = np.arange(len(top))
    rows, columns, owners, seen = [], [], [], 0
    for a, b in parts:
        s = split(column.slice(a, b - a))
        c = index[np.where(s.features >= 0, s.features, m)].ravel()
        rows.append(np.repeat(s.sentence, s.features.shape[1])[c >= 0] + seen)
        columns.append(c[c >= 0])
        owners.append(s.text + a)
        seen += len(s.text)
    row, column, text = np.concatenate(rows), np.concatenate(columns), np.concatenate(owners)
    w, c = np.zeros(len(top)), -4.0  # c: the learned chance, as a logit
    g2, gc2 = np.full(len(top), 1e-8), 1e-8
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for step in range(steps):
        z = BACKGROUND + np.bincount(row, w[column], len(text))
        a = np.logaddexp(0, c) + np.bincount(text, np.logaddexp(0, z) - np.logaddexp(0, BACKGROUND), n)
        slope = np.where(y == 1, -1 / np.expm1(a), 1.0) * weight  # of the loss, by a
        gw = np.bincount(column, (slope[text] / (1 + np.exp(-z)))[row], len(top))
        gc = slope.sum() / (1 + np.exp(-c))
        g2, gc2 = g2 + gw * gw, gc2 + gc * gc
        rate = 0.3 / np.sqrt(g2)
        w = np.maximum(w - rate * (gw + l1), 0)
        c -= 0.3 / np.sqrt(gc2) * gc
    full = np.zeros(m + 1, np.float32)
    full[top] = w
    return Model(full, float(np.logaddexp(0, c)))


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = 32768, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on a bounded sample: about `per_class` labelled rows a class outside the held-out fold, texts of `most_bytes` at most; equal texts count once."""
    rows = labelled_rows(documents, labels, "toxic", per_class, most_bytes, id_column, text_column).orderBy("id").toPandas()
    rows = rows.drop_duplicates("text")
    return fit(rows["text"].tolist(), rows["y"].to_numpy(np.float64))


def score_texts(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5, carry: list[str] = ()) -> DataFrame:
    """Per row: id, carried columns, score, predicted, and the worst sentence as n_offending (sentences over the threshold), worst_start, worst_bytes (UTF-8 bytes, null without a sentence), worst_score."""
    names = [f"c{k}" for k in range(1 + len(carry))]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts, 1 << 19):
                s = split(texts.slice(a, b - a))
                score, each = model.score(s)
                n = b - a
                over = np.bincount(s.text[each >= threshold], minlength=n)
                order = np.lexsort((np.arange(len(each)), -each, s.text))
                head = order[np.flatnonzero(np.diff(s.text[order], prepend=-1))]
                worst = np.full(n, -1)
                worst[s.text[head]] = head
                none = worst < 0
                base = text_buffer(texts.slice(a, b - a))[1][:-1]
                pick = lambda v: np.where(none, 0, v[worst]) if len(v) else np.zeros(n)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(a, n) for k in range(len(names))),
                    pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(over.astype(np.int64)),
                    pa.array((pick(s.start) - base).astype(np.int64), mask=none), pa.array(pick(s.end - s.start).astype(np.int64), mask=none), pa.array(pick(each).astype(float), mask=none)],
                    names=[*names, "score", "predicted", "n_offending", "worst_start", "worst_bytes", "worst_score"])

    kept = [id_column, *carry]
    kinds = ", ".join(f"{n} {documents.schema[c].dataType.simpleString()}" for n, c in zip(names, kept))
    out = documents.select(*(F.col(c).alias(n) for n, c in zip(names, kept)), F.col(text_column).alias("t")).mapInArrow(tidy(run), f"{kinds}, score double, predicted int, n_offending long, worst_start long, worst_bytes long, worst_score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, kept)), "score", "predicted", "n_offending", "worst_start", "worst_bytes", "worst_score")


def held_out(id_column: str = "doc_id"):
    return fold(id_column) == 0


def keep_clean(documents: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `documents`, all columns, whose text scores below the threshold; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(texts, 1 << 19):
                score, _ = model.score(split(texts.slice(a, b - a)))
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))

    return documents.mapInArrow(tidy(run), documents.schema)
