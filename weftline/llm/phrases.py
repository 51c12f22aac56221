"""Operator 13: phrase collocations, mined with hashed bucket counts (PCY, DHP) and Apriori pruning.

A pass over the texts counts the phrases of one length exactly and, in a table of ``2 ** bits`` buckets, those of the next length by
their hash. Between two passes the frequent phrases and the full buckets become bitmaps of that many bits, which every task gets;
their size doesn't depend on the table. A pass counts a phrase only where both phrases of one word less within it and its own bucket
are marked: bitmaps let too many through, never too few, and what they let through is counted exactly, by the words themselves. A task
counts a million words at a time, the engine adds up. A third of the words may be one word or one language: keys gather counts, not texts.

A candidate phrase is scored by its weakest cut, in exact decimals, and dropped if a longer candidate that contains it has half its count.

Defined results: null text counts as empty, null languages as ``und``, with those that are called so; only A-Z are lower-cased; repeated rows
count each; of equal scores and counts the first phrase bytewise comes first. A text or table without phrases adds no row. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, few, mix

#: Occurrences that make a phrase frequent, words of the longest phrase, phrases told of each language.
LEAST, LONGEST, TOP = 10, 3, 2000
#: A longer candidate with this share of the count (as a fraction) drops the phrases in it.
INSIDE = (50, 100)
#: Buckets of a bitmap: 16,777,216 bits, 2 MB. A task counts them in a byte each, up to ``LEAST``.
BITS = 24
#: Parts that a language's phrases are ranked in before they are ranked as a whole.
PARTS = 64
#: Buckets that one row hands on, and words whose phrases a task counts at a time.
BLOCK, WORDS = 1 << 16, 1_000_000
#: What texts are cut at becomes a line feed, A-Z become small letters.
_CUT = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, n long, block long, full binary"


def words_of(text: bytes) -> list[bytes | None]:
    """The words of a text, with None after each piece."""
    out: list[bytes | None] = []
    for piece in text.translate(_CUT).split(b"\n"):
        if words := piece.split():  # of a piece only blanks and tabs are left to split at
            out += words
            out.append(None)
    return out


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more, of that word's hash."""
    return mix(hashes * _STEP + last)


class Marks:
    """Bitmaps of ``2 ** bits`` buckets: ``known`` marks those of frequent phrases, ``open`` those that the next length filled."""

    def __init__(self, bits: int, known: np.ndarray | None = None, open_: np.ndarray | None = None):
        self.bits, self.known, self.open = bits, known, open_

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def among(self, marked: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = self.bucket(hashes)
        return (marked[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Numbered:
    """The words of texts of one language, as numbers: a word is kept once, however often it occurs. 0 ends a piece."""

    def __init__(self) -> None:
        self.number: dict = defaultdict(itertools.count().__next__)
        self.number[None]  # 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)


def counted(lang: str, texts: Numbered, n: int, marks: Marks) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Phrases of n words that the bitmaps let through, how often each occurs, and the buckets of the next length's occurrences whose parts were let through."""
    words, ids = [*texts.number], np.concatenate([np.zeros(0, np.int32), *texts.parts]).astype(np.int64)
    hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(lang, words[1:])])[ids]
    run, whole, parts = hashes, ids > 0, None  # of the runs of k words: hash, whether no piece ends inside, and the same of k - 1
    for k in range(1, n):
        parts = (run, whole)
        run, whole = longer(run[:-1], hashes[k:]), whole[:-1] & (ids[k:] > 0)
    ok = whole
    if parts is not None:  # Apriori: both phrases of n - 1 words are frequent; then the bucket of the phrase itself
        frequent = parts[1] & marks.among(marks.known, parts[0])
        ok = whole & frequent[:-1] & frequent[1:]
        ok[ok] = marks.among(marks.open, run[ok])
    at = np.flatnonzero(ok)
    key = ids[at]
    for k in range(1, n):
        key = np.unique(key * len(words) + ids[at + k], return_inverse=True)[1]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    shown = [[words[i] for i in ids[at[first] + k].tolist()] for k in range(n)]
    both = np.flatnonzero(ok[:-1] & ok[1:])
    return shown[0] if n == 1 else [b" ".join(x) for x in zip(*shown, strict=True)], times, marks.bucket(longer(run[both], hashes[both + n]))


def count_pass(docs: DataFrame, n: int, marks: Marks, least: int, more: bool) -> DataFrame:
    """``COUNTS`` of the phrases of n words, a row for each batch they are counted in; with n = 1 each language's words (no phrase); with ``more`` blocks of the next length's buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, waiting = shared.value, {}
        full = np.zeros(1 << marks.bits if more else 0, np.uint8 if least < 256 else np.uint32)

        def told(**columns: pa.Array) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int64(), "full": pa.binary()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=[*kinds])

        def take(lang: str) -> Iterator[pa.RecordBatch]:
            phrases, times, after = counted(lang, waiting.pop(lang), n, marks)
            if phrases:
                yield told(lang=pa.array([lang] * len(phrases)), phrase=pa.array(phrases, pa.binary()).cast(pa.string()), n=pa.array(times))
            if n == 1:
                yield told(lang=pa.array([lang]), n=pa.array([int(times.sum())]))
            if more:
                at, times = np.unique(after, return_counts=True)
                full[at] = np.minimum(full[at] + times, least)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                waiting.setdefault(lang, Numbered()).add(words_of(text.as_py()))
                if waiting[lang].size >= WORDS:
                    yield from take(lang)
            if sum(x.size for x in waiting.values()) >= 4 * WORDS:
                for lang in [*waiting]:
                    yield from take(lang)
        for lang in [*waiting]:
            yield from take(lang)
        for k, block in enumerate(full.reshape(-1, min(BLOCK, len(full) or 1))):
            if block.any():
                yield told(block=pa.array([k]), full=pa.array([pa.compress(block.astype("<u4" if least > 255 else "u1").tobytes(), codec="zstd", asbytes=True)]))

    return docs.mapInArrow(run, COUNTS)


def open_buckets(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bitmap of the buckets that occur ``least`` times in all blocks (block, full); a task adds up one block at a time."""
    size = min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(k: int, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])], names=["block", "marks"])

        at, sums = None, np.zeros(size, np.uint64)
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at is not None and k != at:
                    yield told(at, sums)
                    sums[:] = 0
                kind = np.dtype("<u4") if least > 255 else np.dtype("u1")
                at = k
                sums += np.frombuffer(pa.decompress(packed, decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True), kind)
        if at is not None:
            yield told(at, sums)

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, marks binary").toLocalIterator():
        out[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(bytes(r.marks), np.uint8)
    return out


def known_buckets(phrases: DataFrame, marks: Marks) -> np.ndarray:
    """The bitmap of the buckets of phrases (lang, phrase), put together by the engine in parts of 4 kB."""

    @F.pandas_udf("long")
    def bucket(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        out = np.zeros(len(lang), np.int64)
        for k, own in lang.groupby(lang).indices.items():
            columns = [*zip(*(p.split(b" ") for p in phrase.iloc[own].str.encode("utf-8")), strict=True)]
            hashes = word_hashes(k, columns[0])
            for c in columns[1:]:
                hashes = longer(hashes, word_hashes(k, c))
            out[own] = marks.bucket(hashes)
        return pd.Series(out)

    place = phrases.select((bucket("lang", "phrase") + 1).alias("place"))
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    out = np.zeros(max((1 << marks.bits) // 8, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.marks), np.uint8)
    return out


def frequent(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n_words and n of all phrases of up to ``longest`` words that occur ``least`` times, and each language's words (lang, n)."""
    marks, found, totals = Marks(bits), [], None
    for n in range(1, longest + 1):
        more = n < longest
        counts = scratch.keep(count_pass(docs, n, marks, least, more), f"counts-{n}")
        if n == 1:
            totals = scratch.keep(counts.where("phrase is null and block is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        own = counts.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        own = scratch.keep(own.select("lang", "phrase", F.lit(n).alias("n_words"), "n"), f"frequent-{n}")
        found.append(own)
        if more:
            marks = Marks(bits, known_buckets(own, marks), open_buckets(counts.where("block is not null").select("block", "full"), bits, least))
        scratch.drop(f"counts-{n}")
    return reduce(DataFrame.unionByName, found), totals


def scored(phrases: DataFrame, scratch: Scratch, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n_words, a, l, r and score of the phrases of two words or more: the cut with the lowest score, of equal ones the first.

    Each cut's parts are looked up among the phrases; they are frequent, since the whole is.
    """
    long = phrases.where("n_words > 1").withColumn("words", F.split("phrase", " ", -1))
    cuts = None
    for k in range(1, longest):
        own = long.where(F.col("n_words") > k).select("lang", "phrase", "n_words", F.col("n").alias("a"), F.lit(k).alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("left"), F.array_join(F.expr(f"slice(words, {k + 1}, n_words - {k})"), " ").alias("right"))
        cuts = own if cuts is None else cuts.unionByName(own)
    # decided by the phrases and their number, not by the texts
    by = phrases.select(F.col("lang").alias("by_lang"), F.col("phrase").alias("by_phrase"), "n")
    by = F.broadcast(by) if few(phrases) else by
    for side in ("left", "right"):
        cuts = cuts.join(by, (F.col("lang") == F.col("by_lang")) & (F.col(side) == F.col("by_phrase"))).withColumn(f"n_{side}", F.col("n")).drop("by_lang", "by_phrase", "n")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.floor(F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a") / (exact("n_left") * exact("n_right")))
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", F.col("n_left").alias("l"), F.col("n_right").alias("r"))).alias("best"))
    return scratch.keep(best.select("lang", "phrase", "n_words", "a", "best.l", "best.r", "best.score"), "scored")


def outside(candidates: DataFrame, longest: int = LONGEST, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """The candidates that lie in no longer one with that share of their count."""
    words = F.split("phrase", " ", -1)
    held = candidates.where("n_words > 2").withColumn("words", words).withColumn("width", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    held = held.withColumn("at", F.explode(F.expr("sequence(1, n_words - width + 1)")))
    most = held.groupBy(F.col("lang").alias("of_lang"), F.array_join(F.expr("slice(words, at, width)"), " ").alias("of_phrase")).agg(F.max("a").alias("longer"))
    met = candidates.join(most, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("of_phrase")), "left")
    return met.where(F.col("longer").isNull() | (inside[1] * F.col("longer") < inside[0] * F.col("a"))).drop("of_lang", "of_phrase", "longer")


def collocations(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases, totals = frequent(texts, scratch, longest, least, bits)
    best = outside(scored(phrases, scratch, longest), longest)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's phrases are ranked in parts first, so that no task orders them all
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
