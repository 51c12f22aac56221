"""Shared ground of the operators: tables that cut lineage, and word hashes over Arrow text columns.

Intermediate tables go to a folder below the shared folder that the session names in
``spark.checkpoint.dir``, so a lost executor costs only the stage that runs. Text is cut into words
with numpy over the bytes of a slice of the batch, never in a Python loop over words.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at a time; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session that names none gets a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_SCOPES: list[list[Scratch]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are written within are deleted at its end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for s in _SCOPES.pop():
            s.drop()


class Scratch:
    """Parquet tables in the shared folder. ``keep`` writes a table and reads it again, which cuts its lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Delete these tables, or the whole folder."""
        try:
            for x in names or [""]:
                self.delete(self.spark, f"{self.root}/{x}".rstrip("/"))
        except Exception:  # the session may have ended before the interpreter does
            if names:
                raise


def text_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the bounds of its rows in them; null counts as empty."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string()).fill_null("")
    _, bounds, data = col.buffers()
    bounds = np.frombuffer(bounds, np.int64)[col.offset : col.offset + len(col) + 1] if bounds else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with at most ``limit`` bytes, one row at least."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield a, b
        a = b


def sampled_ids(labels: DataFrame, per_label: int) -> list[tuple[object, object]]:
    """At most ``per_label`` (id, label) of each label by the order of the ids' hashes, label by label; ids with two labels are left out.

    Each label's ids are thinned by a bound on the hash of its own, which a sketch of its distinct ids gives, so no task and no window gathers a
    label. The driver ranks what is left, about twice what is asked for. Where ids with two labels make that too few, the bound of that label
    alone is widened, by four at a time: what a label hands to the driver stays below about four times what is asked for, whatever the table.
    """
    keys = labels.where("id is not null and label is not null").select("id", "label", F.xxhash64("id").alias("h"))
    many = {r.label: r.n for r in keys.groupBy("label").agg(F.approx_count_distinct("id").alias("n")).collect()}
    taken: dict = {}
    wide = dict.fromkeys(many, 1.0)
    while open_ := [y for y in many if y not in taken]:
        share = {y: min(1.0, wide[y] * (2 * per_label + 500) / max(1, many[y])) for y in open_}
        bounds = {y: int(-(2**63) + s * (2**64 - 1)) if s < 1 else 2**63 - 1 for y, s in share.items()}
        bound = F.coalesce(*[F.when(F.col("label") == F.lit(y), F.lit(b)) for y, b in bounds.items()])
        # all rows of an id share its hash, so an id is thinned with all its labels where the widest bound holds it
        thin = keys.where(F.col("h") <= F.lit(max(bounds.values()))).groupBy("id", "h").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        rows = thin.where(F.col("label") == F.col("other")).where(F.col("h") <= bound).select("id", "label", "h").collect()
        for y in open_:
            own = sorted(((r.h, r.id) for r in rows if r.label == y), key=lambda x: (x[0], str(x[1])))[:per_label]
            if len(own) >= per_label or share[y] >= 1:
                taken[y] = own
            wide[y] *= 4
    return [(k, y) for y in sorted(taken) for _, k in taken[y]]


def bounded_sample(docs: DataFrame, labels: DataFrame, per_label: int, total_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[object, str, bytes]]:
    """(label, id, text) of at most ``per_label`` documents of each label and ``total_bytes`` bytes, for the driver.

    ``labels`` has the columns id and label. Ids come in the order of their hashes, so every run takes the same. Every label
    has an equal share of the bytes; a text longer than what is left of its label's share is passed over, shorter ones after it
    may still be taken. An id labelled in two ways is not learned from; of an id with several texts the first one by order is.
    Only the texts that fit are fetched.
    """
    spark = docs.sparkSession
    picked = sampled_ids(labels, per_label)
    if not picked:
        return []
    left = dict.fromkeys((y for _, y in picked), total_bytes // len({y for _, y in picked}))
    rank = {k: i for i, (k, _) in enumerate(picked)}

    def having(wanted: list) -> DataFrame:
        few_ids = spark.createDataFrame([(k,) for k in wanted], docs.select(F.col(id_col).alias("wanted")).schema)
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
        return texts.join(F.broadcast(few_ids), F.col("id") == F.col("wanted")).select("id", "text")

    size = {r[0]: r[1] for r in having([k for k, _ in picked]).groupBy("id").agg(F.max(F.octet_length("text"))).collect()}
    taken = {}
    for k, y in picked:
        if 0 < size.get(k, 0) <= left[y]:
            left[y] -= size[k]
            taken[k] = y
    if not taken:
        return []
    found: dict = {}
    for r in having([*taken]).groupBy("id").agg(F.min("text")).toLocalIterator():
        found[r[0]] = r[1]
    return [(taken[k], k, found[k].encode()) for k in sorted(found, key=rank.__getitem__)]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Words are hashed as polynomials over two prime fields of this order, with bases and byte values drawn once.
PRIME = (1 << 31) - 1
_rng = np.random.default_rng(20240229)
_LANES = [(_rng.integers(1, PRIME, 256, dtype=np.uint64), int(_rng.integers(2**20, PRIME))) for _ in range(2)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _fold(x: np.ndarray) -> np.ndarray:
    """A number below 2**32 that is equal modulo the prime, of one below 2**63."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By lane the powers of its base and of the base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n, made = max(n, SLICE_BYTES + 1), []
        for _, base in _LANES:
            pair = []
            for b in (base, pow(base, -1, PRIME)):
                p = np.ones(1, np.uint64)
                while len(p) < n:
                    p = np.concatenate([p, p * np.uint64(pow(b, len(p), PRIME)) % np.uint64(PRIME)])
                pair.append(p[:n])
            made.append(tuple(pair))
        _POWERS[:] = made
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def sums_of(raw: np.ndarray) -> list[np.ndarray]:
    """By lane the prefix sums from which ``span_hash`` takes the hash of any span."""
    out = []
    for (byte, _), (up, _) in zip(_LANES, _powers(len(raw) + 1), strict=True):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_fold(byte[raw] * up[: len(raw)]), out=sums[1:])
        out.append(sums)
    return out


def span_hash(sums: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [a, b): equal for equal bytes, wherever they stand."""
    x, y = (((s[b] - s[a]) % np.uint64(PRIME)) * down[a] % np.uint64(PRIME) for s, (_, down) in zip(sums, _powers(len(sums[0])), strict=True))
    return mix(x << np.uint64(31) | y)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ and, by row, the bounds of its words. A word ends with its row."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(left), np.flatnonzero(right) + 1
    return a, b, np.searchsorted(a, bounds)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and by row the bounds of its words.

    Takes any number of rows; it works through slices, and through the pieces between white space of a longer row.
    """
    parts, counts = [], np.zeros(len(bounds) - 1, np.int64)
    for i, j in slices(bounds):
        for a, b in pieces(raw, int(bounds[i]), int(bounds[j])) if j == i + 1 else [(int(bounds[i]), int(bounds[j]))]:
            cut = LOWER[raw[a:b]]
            s, e, at = word_spans(cut, np.clip(bounds[i : j + 1] - a, 0, b - a))
            parts.append(span_hash(sums_of(cut), s, e))
            counts[i:j] += np.diff(at)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(counts)])


def pieces(raw: np.ndarray, a: int, b: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Parts of [a, b) of about ``limit`` bytes, cut before white space, so that no word is cut."""
    while b - a > limit:
        c = a + limit
        while c < b and not SPACE[raw[c]]:
            c += 1
        yield a, c
        a = c
    yield a, b


#: Rows of ids up to which a join may broadcast them; counted before the choice.
BROADCAST_IDS = 200_000


def few(df: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether a written table has so few rows that a join may broadcast it."""
    return df.limit(limit + 1).count() <= limit


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is (left_semi) or isn't (left_anti) in the written table ``ids``; null equals null.

    Ids are broadcast only when counted to be few; else both sides are shuffled. No column of ``docs`` can clash with the join's own.
    """
    own = free(docs, "picked")
    ids = ids.select(F.col(id_col).alias(own))
    return docs.join(F.broadcast(ids) if few(ids) else ids, F.col(id_col).eqNullSafe(F.col(own)), how)


def join_sized(rows: DataFrame, side: DataFrame, on: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """Join rows with a written table that has one row per key and, in ``size``, how many rows have the key.

    Keys with more rows than a ``BROADCAST_IDS``-th of all (and 1,000) are at most ``BROADCAST_IDS``: they are sent to the rows, so that a
    hot key is not one task's. The others are joined as usual.
    """
    on = [on] if isinstance(on, str) else on
    most = max(1000, (side.agg(F.sum(size)).first()[0] or 0) // BROADCAST_IDS)
    hot = side.where(F.col(size) > most)
    met = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(side.where(F.col(size) <= most), on, how)
    return met.unionByName(rest)
