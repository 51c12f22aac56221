"""Operator 10: exact dedup against immutable snapshots, screened by static binary-fuse filters.

A store is a folder of segments, one for each batch that was absorbed; a segment never changes once it is written. It has

- ``counts``: for every distinct text of the batch its digest, how often it occurs and which row of it stays,
- ``buckets``: the normalised bytes of the texts that no earlier segment has, by digest,
- ``filters``: a binary-fuse filter for each shard of the digests in ``buckets``,
- ``about``: one row with the sizes, written last; a segment without it is one that was not finished and is written anew.

``absorb`` groups a batch among itself, meets its digests with the filters of every earlier segment, and joins those that a
filter lets through with that segment's exact buckets, where the normalised bytes are compared. ``merged`` adds up the
segments. Filters are built once, when their segment is written. Every step keeps one row per distinct text: no group of
copies is ever gathered, and a filter meets its digests in parts whose size doesn't depend on the batch's.

Defined results: null text counts as empty, and all texts without content are one group. Of equal texts the row with
the most code points stays, then the smallest id; a null id comes last. Of rows with the same text and id exactly one
stays. Two different texts with one SHA-256 digest are an error, not a group. An empty table gives an empty result; other
columns are not read, and none of their names can clash with a column of the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, few, join_sized, mix, pick, slices, text_of

#: Characters that normalisation deletes.
BLANK = b" \t\n\x0b\x0c\r"
#: Digests of a filter, and of a batch that one task holds against a filter.
SHARD_KEYS = 50_000
#: How texts are kept.
PRESSED = {"compression": "zstd"}


class Fuse:
    """A three-wise binary-fuse filter with 16-bit fingerprints over distinct 64-bit keys, built by peeling in rounds."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and the three slots, in neighbouring segments, of each key."""
        h = mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
        mask, step = np.uint64(segment - 1), np.uint64(segment)
        slots = np.stack([first, (first + step) ^ (h >> np.uint64(18) & mask), (first + step + step) ^ (h & mask)])
        return (h ^ h >> np.uint64(32)).astype(np.uint16), slots.astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        n = max(2, len(keys))
        segment = max(4, 1 << int(np.log(n) / np.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        count = max(1, int(np.ceil(n * factor / segment)) - 2)
        for seed in range(1000):
            if seed % 50 == 49:
                count += 1
            prints, slots = cls.places(keys, seed, segment, count)
            size = segment * (count + 2)
            load = np.bincount(slots.ravel(), minlength=size)
            whose = np.bincount(slots.ravel(), np.tile(np.arange(len(keys), dtype=float), 3), size)  # sum of the keys in a slot
            rounds, left = [], len(keys)
            while left:
                lone = np.flatnonzero(load == 1)
                got, at = np.unique(whose[lone].astype(np.int64), return_index=True)
                if not len(got):
                    break
                rounds.append((got, lone[at]))
                gone = slots[:, got].ravel()
                load -= np.bincount(gone, minlength=size)
                whose -= np.bincount(gone, np.tile(got.astype(float), 3), size)
                left -= len(got)
            if left:
                continue
            out = np.zeros(size, np.uint16)
            for got, at in reversed(rounds):
                a, b, c = slots[:, got]
                out[at] = prints[got] ^ out[a] ^ out[b] ^ out[c]  # its own slot is still 0
            return cls(seed, segment, count, out)
        raise ValueError("keys are not distinct")

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was built in, and for about one in 65536 others."""
        prints, (a, b, c) = self.places(keys, self.seed, self.segment, self.count)
        return prints == self.prints[a] ^ self.prints[b] ^ self.prints[c]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_points, digest (SHA-256 of the normalised text), key (its first 8 bytes) and plain (the normalised text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_of(batch.column(1))
            for i, j in slices(bounds):
                part, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                view = memoryview(part)
                plain = [bytes(view[a:b]).translate(None, BLANK) for a, b in zip(at[:-1], at[1:], strict=True)]
                digests = [hashlib.sha256(t).digest() for t in plain]
                starts = np.flatnonzero((part & 0xC0) != 0x80)  # a code point's first byte
                points = np.diff(np.searchsorted(starts, at))
                keys = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(points.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(keys), pa.array(plain, pa.binary())], names=["id", "n_points", "digest", "key", "plain"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_points long, digest binary, key long, plain binary")


def groups(prints: DataFrame) -> DataFrame:
    """One row per distinct digest: size, best (which orders its rows by who stays) and plain. ``prints`` has a rid, unique in its row."""
    best = F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "rid")
    one = prints.groupBy("key", "digest").agg(F.count("*").alias("size"), F.min(best).alias("best"), F.min("plain").alias("plain"), F.max("plain").alias("other"))
    checked = F.when(F.col("plain") == F.col("other"), F.col("plain")).otherwise(F.raise_error(F.lit("two texts have one SHA-256 digest")).cast("binary"))
    return one.select("key", "digest", "size", "best", checked.alias("plain"))


def shard(shards: int) -> F.Column:
    return F.pmod("key", F.lit(shards)).cast("long")


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard of distinct digests, as a row."""

    def run(_: tuple, keys: pa.Table) -> pa.Table:
        f = Fuse.build(np.unique(keys["key"].to_numpy()).view(np.uint64))
        return pa.table({"shard": keys["shard"][:1].cast(pa.int64()), "seed": [f.seed], "segment": [f.segment], "count": [f.count], "prints": [f.prints.tobytes()]})

    return buckets.select(shard(shards).alias("shard"), "key").groupBy("shard").applyInArrow(run, "shard long, seed long, segment long, count long, prints binary")


def screen(batch: DataFrame, n: int, filters: DataFrame, shards: int) -> DataFrame:
    """key and digest of the n groups of a batch that the filter of their shard lets through.

    Where a shard has more of the batch than ``SHARD_KEYS``, its digests are dealt to several parts that meet the filter each.
    """
    parts = max(1, -(-n // (shards * SHARD_KEYS)))

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.select(["key", "digest"])
        if not len(own) or not len(rows):
            return rows.slice(0, 0)
        f = own.to_pylist()[0]
        fuse = Fuse(f["seed"], f["segment"], f["count"], np.frombuffer(f["prints"], np.uint16))
        return rows.filter(pa.array(fuse.has(rows["key"].to_numpy().view(np.uint64))))

    left = batch.select("key", "digest", shard(shards).alias("shard"), F.pmod(F.xxhash64("digest"), F.lit(parts)).alias("part"))
    own = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInArrow(run, "key long, digest binary")


class Store:
    """A folder of segments below ``root``; ``segments`` are the finished ones, in order."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, number: int, name: str) -> str:
        return f"{self.root}/{number:06d}/{name}"

    def table(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(number, name))

    def segments(self) -> list[dict]:
        """Number, distinct texts (n), new texts (fresh) and shards of each finished segment."""
        out: list[dict] = []
        while True:
            try:
                out.append(self.table(len(out), "about").first().asDict())
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                return out

    def write(self, df: DataFrame, number: int, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(number, name))
        return self.table(number, name)


def absorb(store: Store, prints: DataFrame) -> int:
    """Write the next segment from the fingerprints of a batch (with rid, unique in the store); returns its number."""
    before = store.segments()
    number = len(before)
    new = store.write(groups(prints), number, "groups", **PRESSED)
    n = new.count()
    counts = store.write(new.select("key", "digest", "size", "best"), number, "counts")
    known: DataFrame | None = None
    for s in before:
        if not s["fresh"] or not n:
            continue
        passed = store.write(screen(counts, n, store.table(s["number"], "filters"), s["shards"]), number, f"passed-{s['number']}")
        passed = F.broadcast(passed) if few(passed) else passed
        old = store.table(s["number"], "buckets").select("key", "digest", F.col("plain").alias("old")).join(passed, ["key", "digest"])
        # in the exact buckets: what the filter let through by mistake has no partner, the others are compared byte by byte
        met = old.join(new.select("key", "digest", "plain").join(passed, ["key", "digest"]), ["key", "digest"])
        same = met.select("key", "digest", F.when(F.col("old") == F.col("plain"), True).otherwise(F.raise_error(F.lit("two texts have one SHA-256 digest")).cast("boolean")).alias("same"))
        known = same if known is None else known.unionByName(same)
    fresh = new.select("key", "digest", "plain")
    if known is not None:
        known = store.write(known.where("same").select("key", "digest"), number, "known")
        fresh = fresh.join(F.broadcast(known) if few(known) else known, ["key", "digest"], "left_anti")
    fresh = store.write(fresh, number, "buckets", **PRESSED)
    m = fresh.count()
    shards = max(1, -(-m // SHARD_KEYS))
    store.write(build_filters(fresh, shards), number, "filters")
    for x in ("groups", "known", *(f"passed-{s['number']}" for s in before)):
        Scratch.delete(store.spark, store.path(number, x))
    about = store.spark.createDataFrame([(number, n, m, shards)], "number int, n long, fresh long, shards int")
    store.write(about.coalesce(1), number, "about")
    return number


def merged(store: Store) -> DataFrame:
    """key, digest, size and best of every distinct text of the store."""
    tables = [store.table(s["number"], "counts") for s in store.segments()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out if len(tables) == 1 else out.groupBy("key", "digest").agg(F.sum("size").alias("size"), F.min("best").alias("best"))


def dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Each row's id, keep_id, group_size, kept and text_sha256, with the table as batches that a store absorbs one by one.

    Which batch a row belongs to is drawn by a hash of its id, so copies are spread over all of them.
    """
    rows = scratch.keep(fingerprints(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "rows", **PRESSED)
    store = Store(docs.sparkSession, scratch.path("store"))
    for k in range(batches):
        absorb(store, rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
    out = join_sized(rows.select("id", "rid", "key", "digest"), scratch.keep(merged(store), "merged"), ["key", "digest"], "size")
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by id; rows of an id that occurs more than once also by their text, of which one row stays, whatever the run.
    """
    found = scratch.keep(dedup(docs, scratch, id_col, text_col).select(F.col(id_col).alias("id"), "kept", "text_sha256"), "found")
    scratch.drop("rows", "store")
    repeated = scratch.keep(found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated")
    dropped = scratch.keep(found.where("not kept").join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_anti").select(F.col("id").alias(id_col)), "dropped")
    out = pick(docs, dropped, "left_anti", id_col)
    if repeated.isEmpty():
        return out
    # an id that occurs more than once: the whole row travels as one value, beside what tells it apart
    again = repeated.withColumnRenamed("again", id_col)
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANK.decode(), "")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = pick(docs, again, "left_semi", id_col).select(F.col(id_col).alias("id"), F.sha2(plain, 256).alias("sha"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), row.alias("row"))
    kept = found.where("kept").select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    several = several.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    # rows alike in id, text and length: the greatest by its values, so that every run keeps the same
    first = several.groupBy("id", "sha").agg(F.max_by("row", F.struct("points", F.to_json("row"))).alias("row")).select("row.*")
    return pick(out, again, "left_anti", id_col).unionByName(first)
