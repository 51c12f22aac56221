"""Operator 1: near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; a table's bucket is k quantised random projections floor((a.x + b) / w). Vectors that share a
bucket in one of L tables are compared by exact cosine in double precision. k grows with the logarithm of the number of
distinct vectors, so that chance meetings stay rare, and L follows from the recall wanted for a pair just at the
threshold; closer pairs are found more surely.

Identical vectors are one class with a count, told apart by their components and not by a hash, so copies are never paired. Within a bucket links are counted and reduced
to a spanning forest where they are found, so no pair leaves the task. A pair that meets in several tables counts in the
first one. A bucket of more than ``BLOCK`` classes is compared block by block: all its pairs, in no single task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept.
Vectors of different lengths never link. Repeated rows link with each other; a null id is never a component's id unless
all ids of the component are null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, mix
from weftline.llm.near import block_pairs, components, grouped, labels, runs

THRESHOLD, RECALL, WIDTH, BLOCK, SEED = 0.95, 0.995, 2.0, 2048, 7


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection agrees for two points at this distance."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections per table and tables for n distinct vectors; unrelated vectors are taken as orthogonal."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def hashed(x: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """32-bit bucket numbers, rows by tables, of normalised vectors of one length."""
    d = x.shape[1]
    rng = np.random.default_rng([seed, d])
    a, b, odd = rng.standard_normal((d, tables * k)), rng.uniform(0, width, tables * k), rng.integers(1, 2**63, tables * k, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(x), tables), np.uint32)
    for i in range(0, len(x), 2048):
        cell = np.floor((x[i : i + 2048] @ a + b) / width).astype(np.int64).view(np.uint64) * odd
        out[i : i + 2048] = mix(cell.reshape(-1, tables, k).sum(2) + np.uint64(d)) >> np.uint64(32)
    return out


def classes_of(vectors: DataFrame, scratch: Scratch, id_col: str, vec_col: str, hash_of: Callable[..., Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Each row's id, hash (null where it can't link) and vec; each distinct vector's key, hash, copies, first_id and vec.

    Classes are grouped by the vectors themselves, the hash before them only keeps comparisons short; the key is a number of its own.
    """
    v = F.col(vec_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(sound, F.lit(False)), hash_of(v)).alias("hash"), v.alias("vec"))
    classes = rows.where("hash is not null").groupBy("hash", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return rows, scratch.keep(classes.select(F.monotonically_increasing_id().alias("key"), "hash", "copies", "first_id", "vec"), "classes")


def links(classes: DataFrame, n: int, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, found): found links of class a, counted in rows, where b is null; else a and b are in one component."""
    k, tables = shape(n, threshold, recall)
    wide = classes.schema["vec"].dataType.elementType.simpleString() == "double"
    kind = np.float64 if wide else np.float32

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2)
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vec.value_lengths().to_numpy())])
            length, made = np.diff(ends), [b""] * len(vec)
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                x = flat[ends[own][:, None] + np.arange(d)].astype(np.float64)
                x /= abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
                found = hashed(x / np.linalg.norm(x, axis=1, keepdims=True), k, tables)
                for i, s in zip(own, found, strict=True):
                    made[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(made, pa.binary())], names=["key", "copies", "vec", "signs"])

    signed = scratch.keep(classes.select("key", "copies", "vec").mapInArrow(sign, "key long, copies long, vec binary, signs binary"), "signed")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, tables).astype(np.int64)
            where = s + (np.arange(tables, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(where.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), tables))], names=["group", "key"])

    dealt = signed.select("key", "signs").mapInArrow(deal, "group long, key long")
    full = dealt.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    units = block_pairs(dealt.join(full, "group"), block).withColumn("table", F.shiftright("group", 32).cast("int"))
    units = units.select("unit", "table", "part", "key").join(signed, "key")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, copies, part, table, unit = (rows[c].to_numpy() for c in ("key", "copies", "part", "table", "unit"))
        signs = np.frombuffer(b"".join(rows["signs"].to_pylist()), np.uint32).reshape(-1, tables)
        raw = rows["vec"].to_pylist()
        size = np.array([len(r) for r in raw])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.zeros(len(unit), bool)
        for d in np.unique(size):  # a bucket can hold several lengths only if hashes collide
            own = np.flatnonzero(size == d)
            x = np.frombuffer(b"".join(raw[i] for i in own), kind).reshape(len(own), -1).astype(np.float64)
            x = x / abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for a, b in runs(unit[own]):
                if b - a > 12:
                    i, j = np.nonzero(np.triu(x[a:b] @ x[a:b].T >= threshold, 1))
                    found.append((own[a + i], own[a + j]))
                else:
                    small[own[a:b]] = True
            at = np.flatnonzero(small[own])
            for step in range(1, 12):
                i, j = at[:-step], at[step:]
                meet = unit[own[i]] == unit[own[j]]
                if not meet.any():
                    break
                i, j = i[meet], j[meet]
                hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                found.append((own[i[hit]], own[j[hit]]))
        if not found:
            return
        i, j = (np.concatenate([f[s] for f in found]) for s in (0, 1))
        mixed = np.zeros(len(unit), bool)  # units of two blocks compare across only
        for a, b in runs(unit):
            mixed[a:b] = part[a] != part[a:b].max() or part[a] != part[a:b].min()
        ok = ~mixed[i] | (part[i] != part[j])
        i, j = i[ok], j[ok]
        fresh = np.ones(len(i), bool)  # met in no earlier table
        for s in range(0, len(i), 65536):
            c = slice(s, s + 65536)
            same = signs[i[c]] == signs[j[c]]
            fresh[c] = same.argmax(1) == table[i[c]]
        i, j = i[fresh], j[fresh]
        if not len(i):
            return
        n = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some].astype(np.int64))], names=["a", "b", "found"])
        nodes, at = np.unique(np.concatenate([keys[i], keys[j]]), return_inverse=True)
        root = labels(at[: len(i)], at[len(i) :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]]), pa.nulls(len(own), pa.int64())], names=["a", "b", "found"])

    return scratch.keep(grouped(units, "unit", compare, "a long, b long, found long"), "links")


def dedup(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, hash_of: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """id, n_links, component_id and kept of every vector."""
    rows, classes = classes_of(vectors, scratch, id_col, vec_col, hash_of)
    found = links(classes, classes.count(), scratch, threshold, recall, block)
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("found").alias("others"))
    roots = components(found.where("b is not null"), scratch, "star").withColumnRenamed("node", "key")
    named = classes.select("key", "hash", "copies", "first_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    named = named.join(least, "root").join(counts, "key", "left").select("key", "hash", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    on = ["hash"]
    if classes.groupBy("hash").count().where("count > 1").isEmpty():  # a hash names one vector, so vectors needn't meet again
        rows = rows.drop("vec")
    else:
        on, named = ["hash", "vec"], named.join(classes.select("key", "vec"), "key")
    out = rows.join(named.drop("key"), on, "left")
    component = F.when(F.col("hash").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
