"""Operator 9: language identification by error-correcting output codes.

Every language gets a codeword of bits; one logistic classifier over hashed byte n-grams is trained for each bit.
A text's margins are decoded to the codeword of least loss, where each bit's loss is weighted by how well the bit was
learned. The score is the share of the best codeword in exp(-loss); a text whose two best codewords are closer than
``AMBIGUOUS`` is flagged.

Training takes at most ``PER_LANG`` documents of each language and ``TRAIN_BYTES`` bytes of text in all, in an order
drawn by hash; that bound is a parameter. Prediction is a narrow stage over every whole text.

Defined results: null text and text without a letter give ``und`` with score 0. With one known language it is
predicted for every text with a letter, score 1; with none, ``und``. Rows with null lang or text, texts without a letter
and ids with two languages are not learned from. Equal texts score alike, whatever stands beside them.
Ties go to the language that sorts first. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, bounded_sample, pieces, slices, text_of

PER_LANG, TRAIN_BYTES, BITS, AMBIGUOUS = 400, 24_000_000, 16, 0.5

#: ASCII letters in lower case and the bytes of other characters as they are; all else counts as a space.
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 4 languages, else random splits whose nearest rows are far apart."""
    if n <= 4:
        bits = [[1 if c >> k & 1 else -1 for k in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(bits, float).T.reshape(n, -1)
    rng, best = np.random.default_rng(n), (0, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, max(15, int(np.ceil(10 * np.log2(n))))))
        if (abs(code.sum(0)) == n).any():
            continue
        near = min(((code[i] != code[i + 1 :]).sum(1).min() for i in range(n - 1)))
        best = max(best, (int(near), code), key=lambda x: x[0])
    return best[1] if best[1] is not None else code


def grams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the 4 bytes that start at each place, but where all are spaces, and by row the bounds of its numbers.

    Beyond a row's end there are spaces, so no gram runs into the next row.
    """
    low = FOLD[raw]
    upper = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    low[upper] += 0x20
    x, n = low.astype(np.uint32), len(low)
    for k in (1, 2, 3):
        later = np.full(n, 0x20, np.uint32)
        later[: max(0, n - k)] = low[k:]
        for back in range(1, k + 1):
            ends = bounds[1:] - back
            later[ends[ends >= 0]] = 0x20
        x |= later << np.uint32(8 * k)
    some = x != 0x20202020
    at = np.concatenate([[0], np.cumsum(some)])[bounds]
    return (x[some] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), at


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """By row and bit: the classifier's margin, over all n-grams of the text but those of spaces only."""
        sums, count = np.zeros((len(bounds) - 1, len(self.bias))), np.zeros(len(bounds) - 1)
        for i, j in slices(bounds, 1 << 18):
            for a, b in pieces(raw, int(bounds[i]), int(bounds[j]), 1 << 18) if j == i + 1 else [(int(bounds[i]), int(bounds[j]))]:
                at = np.clip(bounds[i : j + 1] - a, 0, b - a)
                found, at = grams(raw[a:b], at)
                rows = np.flatnonzero(np.diff(at))
                if not len(rows):
                    continue
                sums[i + rows] += np.add.reduceat(self.weights[found], at[rows], axis=0)
                count[i:j] += np.diff(at)
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its score and whether the runner-up is close."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss.min(1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return order[:, 0], 1 / share.sum(1), gap < AMBIGUOUS


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, train_bytes: int = TRAIN_BYTES, steps: int = 60) -> Model:
    """Train on the rows with text and language, a sample of bounded rows and bytes, the same on every run."""
    known = labelled.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"))
    sample = [(y, t) for y, _, t in bounded_sample(labelled, known, per_lang, train_bytes, id_col, text_col)]
    sample = [(y, t) for y, t in sample if len(grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])]
    langs = sorted({y for y, _ in sample})
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(0))
    return _train(sample, langs, steps)


def _train(sample: list[tuple[str, bytes]], langs: list[str], steps: int) -> Model:
    code = codewords(len(langs))
    bits = code.shape[1]
    if not bits:
        return Model(langs, code, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(0))
    target = np.array([code[langs.index(l)] for l, _ in sample]).reshape(-1, bits)
    cols, vals, at = [], [], [0]
    for _, t in sample:
        f, c = np.unique(grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], return_counts=True)
        cols.append(f.astype(np.int32))
        vals.append((c / max(1, c.sum())).astype(np.float32))
        at.append(at[-1] + len(f))
    bias = np.zeros(bits)
    f, x, rows = np.concatenate(cols), np.concatenate(vals)[:, None], np.repeat(np.arange(len(sample)), np.diff(at))
    used, f = np.unique(f, return_inverse=True)
    idf = np.sqrt(len(sample) / np.bincount(f, minlength=len(used)))[:, None].astype(np.float32)
    x = x * idf[f]
    w = np.zeros((len(used), bits), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.array([1 / sum(a == l for a, _ in sample) for l, _ in sample])[:, None] / len(langs)
    for t in range(1, steps + 1):
        margin = np.add.reduceat(x * w[f], at[:-1], axis=0) + bias
        d = (-target / (1 + np.exp(target * margin)) * share).astype(np.float32)
        g = np.stack([np.bincount(f, (x[:, 0] * d[rows, k]), len(used)) for k in range(bits)], 1).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
        bias -= 0.5 * d.sum(0)
    right = ((np.add.reduceat(x * w[f], at[:-1], axis=0) + bias) * target > 0).mean(0)
    full = np.zeros((1 << BITS, bits), np.float32)
    full[used] = w * idf
    return Model(langs, code, full, bias, np.clip(2 * right - 1, 0.05, 1))


def has_letter(texts: pa.Array, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By row, whether any character is a letter; rows without an ASCII letter are looked at one by one."""
    out = np.zeros(len(bounds) - 1, bool)
    for i, j in slices(bounds):
        part, own = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        letters = np.flatnonzero((FOLD[part] != 0x20) & (part < 0x80))
        out[i:j] = np.diff(np.searchsorted(letters, own)) > 0
    for i in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, lang_pred, score and ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            raw, bounds = text_of(texts)
            known = has_letter(texts, raw, bounds) & bool(model.langs)
            if len(model.langs) > 1 and len(raw):
                best, p, close = model.decode(model.margins(raw, bounds))
            else:
                best, p, close = np.zeros(len(known), int), np.ones(len(known)), np.zeros(len(known), bool)
            names = np.array([*model.langs, "und"], object)[np.where(known, best, len(model.langs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, p, 0.0)), pa.array(close & known)], names=[id_col, "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
