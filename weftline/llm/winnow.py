"""Operator 11: document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; of every ``WINDOW`` grams in a row the smallest is chosen, the rightmost of equal ones,
and a chosen gram keeps its position. So two texts that share a passage of ``GRAM + WINDOW - 1`` code points share a chosen hash
of it (the guarantee), and no window goes without one. ``likeness`` is the Jaccard similarity of the distinct chosen hashes.

``neighbours`` compares each row with the next one and with an edited text made of both, in descending order of the ids. Rows are
dealt to key ranges by bounds that are rows themselves; the largest row of a range also goes, as a marker, to the end of the range
above it. So texts are shuffled once, and a task streams through its range and holds two texts at a time.

Defined results: null text counts as empty; an empty text has no prints, and two texts without prints are alike (1), one
without is unlike any other (0). A text of fewer than ``GRAM`` code points is one gram, one of fewer than ``WINDOW`` grams one window.
Rows alike in id are ordered by their text's hash, then text, so the order doesn't depend on the run; equal rows follow each other; null
ids come last; a lone row is its own next. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SLICE_BYTES, mix, text_of

#: Code points of a gram, and grams of a window. A shared passage of 55 code points is always found.
GRAM, WINDOW = 16, 40
#: Bytes of text that one range is meant to have.
RANGE_BYTES = 64 << 20
#: What a byte counts, and the base of the rolling hash with its inverse, modulo 2**64; drawn once.
_rng = np.random.default_rng(20250311)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**40, 2**62)) | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers and those of its inverse; they wrap around."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b % 2**64, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS


def starts_of(raw: np.ndarray) -> np.ndarray:
    """Where code points begin in UTF-8 bytes, and the length."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def gram_hashes(raw: np.ndarray, starts: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all grams of ``gram`` code points (of the whole text where it has fewer), by prefix sums."""
    n = len(starts) - 1
    if not n:
        return np.zeros(0, np.uint64)
    gram, out = min(gram, n), []
    for i in range(0, n - gram + 1, SLICE_BYTES):
        j = min(n - gram + 1, i + SLICE_BYTES)
        part, at = raw[starts[i] : starts[j - 1 + gram]], starts[i : j + gram] - starts[i]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        a, b = at[: j - i], at[gram : gram + j - i]
        out.append(mix((sums[b] - sums[a]) * down[a]))
    return np.concatenate(out)


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the grams that are the smallest of a window, the rightmost of equal ones, ascending."""
    n, best, width = len(hashes), np.arange(len(hashes)), 1
    window = min(window, n)
    while width < window:  # the best of a window is that of two windows of half its width or more
        step = min(width, window - width)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return best[np.flatnonzero(np.diff(best, prepend=-1))]


class Prints(NamedTuple):
    """Chosen hashes of a text and their positions, in code points."""

    hashes: np.ndarray
    positions: np.ndarray

    def text(self) -> str:
        """The hashes in order of their positions, 16 hex digits each."""
        return self.hashes.astype(">u8").tobytes().hex()


def prints_of(raw: np.ndarray, starts: np.ndarray | None = None, gram: int = GRAM, window: int = WINDOW) -> Prints:
    hashes = gram_hashes(raw, starts_of(raw) if starts is None else starts, gram)
    at = chosen(hashes, window)
    return Prints(hashes[at], at)


def likeness(a: Prints, b: Prints) -> float:
    """Shared distinct hashes of all distinct ones; 1 where neither has any."""
    x, y = np.unique(a.hashes), np.unique(b.hashes)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def rows_of(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The texts of a column as bytes."""
    raw, bounds = text_of(batch.column(k))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield raw[a:b]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """id, n_chars and prints, array of (hash, position), of each row. No row meets another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s) - 1, prints_of(raw, s, gram, window)) for raw in rows_of(batch, 1) for s in [starts_of(raw)]]
            if not found:
                continue
            hashes, positions = (np.concatenate(x) for x in zip(*(p for _, p in found), strict=True))
            items = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(positions.astype(np.int64))], names=["hash", "position"])
            bounds = np.cumsum([0, *(len(p.hashes) for _, p in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), items)], names=["id", "n_chars", "prints"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_chars long, prints array<struct<hash: long, position: long>>")
    return out.withColumnRenamed("id", id_col)


def ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (id, h, text) with the key range they belong to and marker 0, those that end a range also with marker 1 in the next one; and how many ranges.

    Ends are the last rows of the engine's own range partitions, one for each. They stand in the plan as values, so a
    task that runs again deals its rows alike.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    keys = rows.select(F.struct(F.col("id").isNotNull().alias("has"), "id", "h").alias("key"))
    lasts = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key")).select("key.*").collect()
    ends = spark.sparkContext.broadcast(sorted((True, r.id, r.h) if r.has else (False, r.h) for r in lasts))

    @F.pandas_udf("array<int>")
    def dealt(ids: pd.Series, hashes: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for i, h, has in zip(ids, hashes, known, strict=True):
            key = (True, i, h) if has else (False, h)
            k = bisect_left(ends.value, key)
            out.append([k, (k + 1) % len(ends.value)] if ends.value[k] == key else [k])
        return pd.Series(out)

    known = F.coalesce("id", F.lit("0").cast(rows.schema["id"].dataType))  # a null would turn a batch of whole numbers into floats
    return rows.select("*", F.posexplode(dealt(known, "h", F.col("id").isNotNull())).alias("marker", "range")), len(lasts)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each row's id, n_chars, edited_sha256, fingerprint, edited_fingerprint, n_prints, near_edited and near_next.

    The edited text is the row's own, its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt, n = ranges(rows)
    if not n:
        dealt, n = rows.select("*", F.lit(0).alias("marker"), F.lit(0).alias("range")), 1
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: tuple | None = None  # range, marker, id, bytes, starts and prints of the row before
        for batch in batches:
            where, marker, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, raw in enumerate(rows_of(batch, 3)):
                if marker[k] and (above is None or above[0] != where[k] or above[1]):
                    continue  # a further copy of the marker
                starts = starts_of(raw)
                now = (where[k], marker[k], batch.column(2)[k].as_py(), raw, starts, prints_of(raw, starts, gram, window))
                if above is not None and above[0] == where[k] and not above[1]:
                    out.append(compared(above, now, gram, window))
                above = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.column(2).type), *map(pa.array, list(zip(*out, strict=True))[1:])], names=RESULT)

    order = [F.col("range"), F.col("marker"), F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()]
    ordered = dealt.repartitionById(n, F.col("range")).sortWithinPartitions(*order)
    out = ordered.select("range", "marker", "id", "text").mapInArrow(run, f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, n_prints long, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


RESULT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_prints", "near_edited", "near_next"]


def compared(row: tuple, after: tuple, gram: int, window: int) -> tuple:
    """The values of ``RESULT`` for a row and the next one."""
    _, _, key, raw, starts, own = row
    n = len(starts) - 1
    put = after[3][: after[4][min(n // 2, len(after[4]) - 1)]]
    edited = np.concatenate([raw[: starts[n - n // 2]], put])
    changed = prints_of(edited, None, gram, window)
    return key, n, hashlib.sha256(edited.tobytes()).hexdigest(), own.text(), changed.text(), len(own.hashes), likeness(own, changed), likeness(own, after[5])
