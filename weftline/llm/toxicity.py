"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words and their beginnings;
the document's score is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels: the gradient
of the document's likelihood reaches every sentence through the noisy-or, so the trained weights also locate the
offending sentences.

Training takes at most ``PER_CLASS`` documents of each label, in an order drawn by hash, and at most ``TRAIN_BYTES``
bytes of their text, to the driver; that bound is a parameter. Scoring is a narrow stage over every whole text.

Defined results: a text without a word (null, empty, punctuation) has no sentence and scores 0. Rows whose label or
text is null, and ids that are labelled 0 and 1, are not learned from. Without documents of both labels every score is 0.
Repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, SLICE_BYTES, bounded_sample, slices, span_hash, sums_of, text_of

PER_CLASS, TRAIN_BYTES = 4000, 24_000_000
BITS, FEATURES, PREFIXES = 18, 8192, (4, 5, 6)

LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True


def sentence_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers; the sentence of each; each sentence's row; start and end byte of each sentence's words."""
    raw = LOWER[raw]
    inside = LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(left), np.flatnonzero(right) + 1
    if not len(a):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros((0, 2), np.int64)
    row = np.searchsorted(bounds, a, "right") - 1
    stops = np.cumsum(STOP[raw])[a]
    first = np.ones(len(a), bool)
    first[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(first) - 1
    sums = sums_of(raw)
    found, where = [span_hash(sums, a, b)], [sentence]
    for n in PREFIXES:
        long = np.flatnonzero(b - a > n)
        found.append(span_hash(sums, a[long], a[long] + n) ^ np.uint64(n))
        where.append(sentence[long])
    at = np.flatnonzero(first)
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(where), row[at], np.stack([a[at], b[np.append(at[1:], len(a)) - 1]], 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each sentence's log(1 - p), its row and its byte span."""
        f, s, row, span = sentence_features(raw, bounds)
        known = self.weights[f] != 0
        once = np.unique(s[known] << BITS | f[known])  # a word counts once in a sentence, as in training
        z = self.bias + np.bincount(once >> BITS, self.weights[once & (1 << BITS) - 1], len(row))
        return -np.logaddexp(0, z), row, span

    def clean(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """By row: log of the chance that no sentence offends, and the spans and scores of those with p of 0.5 or more."""
        out, bad = np.zeros(len(bounds) - 1), [(np.zeros((0, 2), np.int64), np.zeros(0))] * (len(bounds) - 1)
        for i, j in slices(bounds):
            for a, b in whole_sentences(raw, int(bounds[i]), int(bounds[j])) if j == i + 1 else [(int(bounds[i]), int(bounds[j]))]:
                logs, row, span = self.sentences(raw[a:b], np.clip(bounds[i : j + 1] - a, 0, b - a))
                out[i:j] += np.bincount(row, logs, j - i)
                hit = np.flatnonzero(logs <= -np.log(2))
                for r in np.unique(row[hit]):
                    own = hit[row[hit] == r]
                    old = bad[i + r]
                    bad[i + r] = (np.concatenate([old[0], span[own] + a - bounds[i + r]]), np.concatenate([old[1], -np.expm1(logs[own])]))
        return out, bad


def whole_sentences(raw: np.ndarray, a: int, b: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Parts of a long text, cut before a sentence's end; where there is none for long, before any byte that ends a word."""
    while b - a > limit:
        c = a + limit
        for at in (STOP[raw[c : c + limit]], ~LETTER[raw[c : c + limit]]):
            if at.any():
                c += int(at.argmax())
                break
        else:
            c = min(c + limit, b)
        yield a, c
        a = c
    yield a, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES, steps: int = 500) -> Model:
    """Train on the documents that ``labels`` marks 0 or 1: a sample of bounded rows and bytes, the same on every run."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = [(y, t) for y, _, t in bounded_sample(docs, marked, per_class, train_bytes, id_col, text_col)]
    y = np.array([s[0] for s in sample], np.int64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS, np.float32), -1e3)
    feats, sents, docs, n = [], [], [], 0
    for k, (_, t) in enumerate(sample):
        f, s, row, _ = sentence_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        f, s = np.unique(np.stack([f, s]), axis=1)
        feats.append(f.astype(np.int32))
        sents.append((s + n).astype(np.int32))
        docs.append(np.full(len(row), k))
        n += len(row)
    return _train(feats, sents, np.concatenate(docs), y, steps)


def _train(feats: list[np.ndarray], sents: list[np.ndarray], docs: np.ndarray, y: np.ndarray, steps: int) -> Model:
    """Keep the features whose presence tells the labels apart best, then descend with Adam."""
    seen = np.zeros((2, 1 << BITS))
    for f, label in zip(feats, y, strict=True):
        seen[label, np.unique(f)] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = seen / total[:, None]
    both = (seen.sum(0) / total.sum()).clip(1e-9, 1 - 1e-9)
    chi = (total[:, None] * (share - both) ** 2).sum(0) / (both * (1 - both))
    chi[seen.sum(0) < 3] = 0
    kept = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    kept = kept[chi[kept] > 12]  # what chance shows in less than one of a thousand features
    number = np.full(1 << BITS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    f, s = number[np.concatenate(feats)], np.concatenate(sents)
    f, s = f[f >= 0], s[f >= 0]
    w, bias, n = np.zeros(len(kept)), -3.0, len(docs)
    weight = np.where(y == 1, total[0] / total[1], 1.0) / total[0]
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(s, w[f], n)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(docs, -np.logaddexp(0, z), len(y))  # log(1 - P)
        pull = np.where(y == 1, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0) * weight
        dz = p * pull[docs]
        g = np.append(np.bincount(f, dz[s], len(kept)) + 1e-4 * w / max(1, len(kept)), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Model(weights, float(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Each row's id, score, predicted (1 from the threshold on) and offending: begin, end and score of its sentences of 0.5 or more, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            logs, bad = model.clean(*text_of(batch.column(1)))
            p = np.clip(-np.expm1(logs), 0, 1)
            spans = [[{"begin": int(a), "end": int(b), "score": float(x)} for (a, b), x in zip(s, q, strict=True)] for s, q in bad]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, kind)], names=[id_col, "score", "predicted", "offending"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, offending array<struct<begin: long, end: long, score: double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that score below the threshold; only texts go to the workers and only a flag comes back."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        logs, _ = model.clean(*text_of(texts))
        return pa.array(-np.expm1(logs) < threshold)

    return docs.where(clean(F.col(text_col)))
