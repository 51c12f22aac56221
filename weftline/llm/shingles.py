"""Operator 5: near-duplicate documents by chosen-path set similarity join.

A document is the set of its distinct 5-word shingles. Documents with the same sequence of words, told by 128 bits of its
SHA-256, are one class. Independent trees branch the classes: a node picks one or two positions of the minwise signature by
its own random choice and sends a class to the child of the token it has there, so classes meet in a child if they share a
minwise token. A node of at most ``LEAF`` classes is compared exhaustively on signatures; larger ones branch again, up to
``LEVELS`` times, and what is larger still is connected block by block (``near.connect``). The number of trees follows from
``RECALL``: a pair just at the threshold is missed with a chance below 1 - RECALL even if all its nodes are as deep as LEVELS
(``missed``, which counts the signature's own chance); the chance for pairs in leaves at the root is far lower.

What is found leaves a node as a spanning forest, never as pairs. Its connected components are candidates; a component
comes together with its texts, in units whose classes and bytes are bounded, and there links are confirmed on the sets of
the words themselves: words and shingles get numbers by comparing them, not hashes. Pairs already connected by confirmed
links need no check, since only components are returned.

Defined results: text without a word (null, empty, white space) has an empty set and links with nothing. Fewer than
five words are one shingle. Rows with equal ids are rows of their own; a null id is never a component's id unless all ids
of the component are null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, Scratch, join_sized, mix, pick, slices, text_of, word_hashes
from weftline.llm.near import components, connect, grouped, labels, runs

WORDS, PERCENT, TOKENS, RECALL, LEAF, LEVELS = 5, 75, 128, 0.999, 800, 3
#: In how many of its numbers a node picks two positions, of every three.
TWO = 1
#: Classes and bytes of text that meet in one unit to be confirmed.
TASK_CLASSES, TASK_BYTES = 4000, 12 << 20
#: Signature agreement that is 3.7 standard deviations below the threshold.
SCREEN = PERCENT / 100 - 3.7 * (PERCENT / 100 * (1 - PERCENT / 100) / TOKENS) ** 0.5

_rng = np.random.default_rng(55)
_WORD, _TOKEN = (_rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in (WORDS, TOKENS))
_LOWER = LOWER.tobytes()


def missed(positions: int, levels: int, similarity: float = PERCENT / 100) -> float:
    """Chance that a pair of this similarity meets in no leaf, if roots pick so many positions and all leaves are ``levels`` below.

    A node that both are in loses them unless they agree at one of the positions it picks and meet below; averaged over
    how many of the ``TOKENS`` agree.
    """
    total = 0.0
    for same in range(TOKENS + 1):
        share, lost = same / TOKENS, 0.0
        for _ in range(levels):
            one = 1 - share + share * lost
            lost = one * (3 - TWO) / 3 + one * one * TWO / 3
        total += math.comb(TOKENS, same) * similarity**same * (1 - similarity) ** (TOKENS - same) * (1 - share + share * lost) ** positions
    return total


@lru_cache
def roots_of(levels: int, recall: float = RECALL) -> tuple[tuple[int, int], ...]:
    """(tree, position) of what the roots pick, one or two each: as many trees as the recall at that depth asks for."""
    out: list[tuple[int, int]] = []
    t = 0
    while missed(len(out), levels) > 1 - recall:
        out += [(t, int(p)) for p in np.random.default_rng([55, t]).choice(TOKENS, 1 + (t % 3 < TWO), replace=False)]
        t += 1
    return tuple(out)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's set of shingle hashes, sorted."""
    words, at = word_hashes(raw, bounds)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        w, n = words[a:b], b - a
        if n >= WORDS:
            total = w[: n - WORDS + 1] * _WORD[0]
            for k in range(1, WORDS):
                total = total + w[k : n - WORDS + 1 + k] * _WORD[k]
            yield np.unique(mix(total))
        else:
            yield mix((w * _WORD[:n]).sum(keepdims=True) + np.uint64(n)) if n else w


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set as 64-bit hashes."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, np.multiply.outer(_TOKEN, shingles[k : k + 4096]).min(1), out=least)
    return mix(least)


def words_of(raw: np.ndarray, bounds: np.ndarray) -> Iterator[list[bytes]]:
    """Each row's words, A-Z lower-cased."""
    view = memoryview(raw)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield bytes(view[a:b]).translate(_LOWER).split()


def digest_of(words: list[bytes]) -> bytes:
    """128 bits that name a sequence of words."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def exact_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Each text's set of shingles as sorted numbers: within the list equal numbers stand for equal words, with no hash between."""
    known: dict[bytes, int] = {}
    w = np.fromiter((known.setdefault(x, len(known)) for t in texts for x in t), np.uint64, sum(map(len, texts)))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a << np.uint64(32) | b, return_inverse=True)[1].astype(np.uint64)

    if len(w) >= WORDS:
        two = paired(w[:-1], w[1:])
        five = paired(paired(two[:-2], two[2:])[: len(w) - 4], w[4:])
    short: dict[tuple, int] = {}
    out = []
    for k, t in enumerate(texts):
        if len(t) >= WORDS:
            out.append(np.unique(five[at[k] : at[k + 1] - WORDS + 1]))
        else:
            out.append(np.array([(1 << 62) + short.setdefault(tuple(t), len(short))] if t else [], np.uint64))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, levels: int = LEVELS) -> DataFrame:
    """id, n_shingles, n_bytes, digest (null without words), sketch (a byte of each token) and roots (the nodes below each tree's root)."""
    chosen = roots_of(levels)
    salt = np.array([t << 8 | p for t, p in chosen], np.uint64)
    where = np.array([p for _, p in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_of(batch.column(1))
            for i, j in slices(bounds):
                part, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                n, digest, sketch, roots = [], [], [], []
                for s, words in zip(shingle_sets(part, at), words_of(part, at), strict=True):
                    n.append(len(s))
                    sig = signature(s) if len(s) else np.zeros(TOKENS, np.uint64)
                    digest.append(digest_of(words) if len(s) else None)
                    sketch.append((sig >> np.uint64(56)).astype(np.uint8).tobytes())
                    roots.append(mix(sig[where] + mix(salt)).view(np.int64))
                made = [pa.array(n, pa.int64()), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(roots, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made], names=["id", "n_shingles", "n_bytes", "digest", "sketch", "roots"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, n_bytes long, digest binary, sketch binary, roots array<long>")


def branch(rows: DataFrame) -> DataFrame:
    """Children of rows (group, key, sketch): a node picks one or two positions by its own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, TOKENS)
            draw = mix(node)
            first = (draw % np.uint64(TOKENS)).astype(np.int64)
            second = (first + 1 + (draw >> np.uint64(32)).astype(np.int64) % (TOKENS - 1)) % TOKENS
            two = np.flatnonzero((draw >> np.uint64(20)) % np.uint64(3) < np.uint64(TWO))
            i, p = np.concatenate([np.arange(len(node)), two]), np.concatenate([first, second[two]])
            child = mix(node[i] + mix((p.astype(np.uint64) << np.uint64(8)) | sketch[i, p]))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(i))], names=["group", "key"])

    return rows.select("group", "key", "sketch").mapInArrow(run, "group long, key long")


def leaves(classes: DataFrame, scratch: Scratch, leaf: int, levels: int) -> DataFrame:
    """Rows (group, key, n) of the nodes to compare: those of 2 to ``leaf`` classes, and at the last level larger ones too."""
    rows = classes.select(F.explode("roots").alias("group"), "key")
    for level in range(levels + 1):
        full = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        met = scratch.keep(rows.join(full, "group"), f"level{level}")
        done = (met if level == levels else met.where(F.col("n") <= leaf)).select("group", "key", "n")
        found = done if level == 0 else found.unionByName(done)
        large = met.where(F.col("n") > leaf)
        if level == levels or large.isEmpty():
            return found
        rows = branch(large.join(classes.select("key", "sketch"), "key")).distinct()
    raise AssertionError


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes of each row of a with each row of b, in pieces of bounded size."""
    step = max(1, (8 << 20) // max(1, b.size))
    return np.concatenate([(a[k : k + step, None, :] == b[None]).sum(2, dtype=np.uint8 if TOKENS < 256 else np.uint16) for k in range(0, len(a), step)])


def candidates(sketch: np.ndarray, size: np.ndarray, part: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of a unit that can reach the threshold and are not of one root, and their agreement; of two parts only pairs across."""
    n = len(sketch)
    got = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, n, 256):
        same = agree(sketch[k : k + 256], sketch[k:])
        i, j = np.nonzero(same >= SCREEN * TOKENS)
        own = (j > i) & (100 * np.minimum(size[k + i], size[k + j]) >= PERCENT * np.maximum(size[k + i], size[k + j])) & (root[k + i] != root[k + j])
        if n and part.min() != part.max():
            own &= part[k + i] != part[k + j]
        got.append((i[own] + k, j[own] + k, same[i[own], j[own]]))
    return tuple(np.concatenate([g[c] for g in got]) for c in range(3))


def forest(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect, within each unit, the classes whose signatures nearly reach the threshold."""
    unit, key, part, size, old = (rows[c].to_numpy() for c in ("unit", "key", "part", "n_shingles", "root"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.zeros(len(unit), bool)
    for s, e in runs(unit):
        if e - s <= 12:
            small[s:e] = True
            continue
        i, j, _ = candidates(sketch[s:e], size[s:e], part[s:e], old[s:e])
        root = labels(i, j, e - s)
        own = np.flatnonzero(root != np.arange(e - s))
        a.append(key[s + own])
        b.append(key[s + root[own]])
    at = np.flatnonzero(small)
    for step in range(1, 12):
        i, j = at[:-step], at[step:]
        meet = unit[i] == unit[j]
        if not meet.any():
            break
        i, j = i[meet], j[meet]
        fit = 100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        for k in range(0, len(i), 16384):
            c = slice(k, k + 16384)
            near = (sketch[i[c]] == sketch[j[c]]).sum(1) >= SCREEN * TOKENS
            a.append(key[i[c][near]])
            b.append(key[j[c][near]])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def confirmed(sets: list[np.ndarray], sketch: np.ndarray, part: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Smallest member of each set's component under links confirmed on full sets and those of one root, most alike signatures first."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    i, j, same = candidates(sketch, size, part, old)
    order = np.argsort(-same.astype(np.int64), kind="stable")
    by = np.argsort(old, kind="stable")
    tied = old[by[1:]] == old[by[:-1]]
    a, b = [by[:-1][tied]], [by[1:][tied]]  # what was connected before
    i, j, root = i[order], j[order], labels(a[0], b[0], n)
    for k in range(0, len(i), 4096):
        open_ = root[i[k : k + 4096]] != root[j[k : k + 4096]]
        x, y = i[k : k + 4096][open_], j[k : k + 4096][open_]
        for s, e in runs(x[(by := np.argsort(x, kind="stable"))]):
            own, others = sets[x[by[s]]], y[by[s:e]]
            cat = np.concatenate([sets[o] for o in others])
            hit = own[np.minimum(np.searchsorted(own, cat), len(own) - 1)] == cat
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[others])[:-1]]))
            good = others[100 * both >= PERCENT * (len(own) + size[others] - both)]
            a.append(np.full(len(good), x[by[s]]))
            b.append(good)
        root = labels(np.concatenate(a), np.concatenate(b), n)
    return root


def check(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of the confirmed components of each unit; rows bring their texts, of which wrong ones are left out."""
    unit, key, part, old = (rows[c].to_numpy() for c in ("unit", "key", "part", "root"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
    digest = rows["digest"].to_pylist()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    texts = rows["text"].combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    for s, e in runs(unit):
        words = list(words_of(*text_of(texts.slice(s, e - s))))
        right = [k for k, x in enumerate(words) if x and digest_of(x) == digest[s + k]]  # an id can be repeated
        seen = {(int(key[s + k]), int(part[s + k])): k for k in reversed(right)}  # and so can its text
        right = np.array(sorted(seen.values()), np.int64)
        root = confirmed(exact_sets([words[k] for k in right]), sketch[s + right], part[s + right], old[s + right])
        own = np.flatnonzero(root != np.arange(len(right)))
        a.append(key[s + right[own]])
        b.append(key[s + right[root[own]]])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, levels: int = LEVELS, task_classes: int = TASK_CLASSES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """id, n_shingles, component_id and kept of every document."""
    rows = scratch.keep(sketches(docs, id_col, text_col, levels), "rows")
    one = rows.where("digest is not null").groupBy("digest").agg(F.min_by(F.struct("id", "n_shingles", "n_bytes", "sketch", "roots"), F.coalesce(F.col("id"), F.lit(2**63 - 1))).alias("x"), F.count("*").alias("size"))
    classes = scratch.keep(one.select(F.monotonically_increasing_id().alias("key"), "digest", "size", F.col("x.id").alias("first_id"), "x.n_shingles", "x.n_bytes", "x.sketch", "x.roots"), "classes")
    met = leaves(classes, scratch, leaf, levels).withColumn("w", F.lit(0))
    slim = classes.select("key", "n_shingles", "sketch")
    near, _ = connect(met, leaf, 1, lambda units: grouped(units.join(slim, "key"), "unit", forest, "a long, b long"), scratch, "near")
    nodes = components(near, scratch, "near_star").withColumnRenamed("node", "key")
    nodes = nodes.join(classes.select("key", "digest", "first_id", "n_bytes", "sketch"), "key")
    sums = nodes.groupBy(F.col("root").alias("group")).agg(F.sum("n_bytes").alias("w"), F.count("*").alias("n"))
    nodes = scratch.keep(nodes.join(sums, F.col("root") == F.col("group")).drop("root"), "nodes")
    ids = scratch.keep(nodes.select(F.col("first_id").alias(id_col)).distinct(), "ids")
    texts = pick(docs.select(F.col(id_col), F.col(text_col)), ids, "left_semi", id_col).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def confirm(units: DataFrame) -> DataFrame:
        full = units.join(nodes.select("key", "digest", "first_id", "sketch"), "key").join(texts, F.col("first_id").eqNullSafe(F.col("doc")))
        return grouped(full.select("unit", "part", "key", "root", "sketch", "digest", "text"), "unit", check, "a long, b long")

    stars, whole = connect(nodes, task_classes, task_bytes, confirm, scratch, "stars")
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root")) if whole else components(stars, scratch, "star")
    named = classes.select("key", "digest", "size", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("component")), "root").select("digest", "size", "component")
    out = join_sized(rows.select("id", "n_shingles", "digest"), scratch.keep(named, "named"), "digest", "size", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their group, with all their columns."""
    found = scratch.keep(dedup(docs, scratch, id_col, text_col).select(F.col(id_col).alias("id"), "kept"), "found")
    kept = found.where("kept").select(F.col("id").alias("kept_id"))
    dropped = scratch.keep(found.where("not kept").join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_anti").select(F.col("id").alias(id_col)).distinct(), "dropped")
    return pick(docs, dropped, "left_anti", id_col)
