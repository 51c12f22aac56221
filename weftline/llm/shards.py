"""Operator 4: token ids in training order, as binary shards.

Documents are encoded with begin and end ids, and stand in one stream in the order of their ids (documents of one id in that
of their tokens; a null id last), which is cut into sequences of ``LENGTH`` ids; only the last sequence is padded, with zero
bytes. A keyed Feistel permutation with cycle-walking maps each sequence's number to its global slot, so the order of training
depends on the documents and the key alone, not on how the input is partitioned, and any slot can be computed without a
table. A shard holds a fixed range of slots at a fixed stride; partitions are ranges of shards, and a task writes its slots
one after another, so a reader can start at any slot of any shard: byte offset = (slot - first slot) * LENGTH * 2.

The job's folder has

- ``encoded``: the ids of every document, written once where the document is (a table that cuts lineage);
- ``starts``: for each part of ``encoded`` where in the stream its documents begin. Only ids, digests and counts are sorted for it;
- ``about``: what the job was started with and how much it encoded, written when the two above are complete. Those are deleted
  when all shards stand, and made again should one be lost later;
- ``shards`` and ``index``: a file of each for every shard. Both are moved into place when they are complete, the shard last.

Then ids cross the network once, cut where sequences end, from ``encoded`` to their shard. A lost task writes its shards
again under names of its own. A job that is started anew with ``resume`` and the same folder encodes nothing again and sends
nothing to shards that stand; other documents, another model, key, length or shard size are an error.

Defined results: null and empty texts give a begin and an end id. Repeated rows are encoded each; an empty table gives no
shard and an empty result. Other columns are not read. An id that doesn't fit in 16 bits is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, text_of
from weftline.llm.pieces import codec
from weftline.llm.warc import open_store

LENGTH, SHARD_SLOTS, KEY, ROUNDS = 2048, 4096, 20240601, 4

#: How ids are kept until they are in their shards: pages of 8 MB shrink them to about half.
PRESSED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(8 << 20)}
#: Partitions of the way to the shards, at most; above, a partition has several shards.
MOST_PARTITIONS = 100_000


def _stir(x: np.ndarray, key: int, k: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(17)


def permute(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A keyed bijection of 0..n-1: balanced Feistel rounds over the next even number of bits, walked until below n."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(x, np.int64).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for k in range(ROUNDS)[:: -1 if back else 1]:
            if back:
                left, right = right ^ _stir(left, key, k) & mask, left
            else:
                left, right = right, left ^ _stir(right, key, k) & mask
        out[todo] = left << h | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part and row (where the document is), id, n, tokens (16-bit ids, little-endian) and mark (64 bits of their digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part, row = codec(model_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, bounds = text_of(texts)
            for i, j in slices(bounds):
                ids = c.encode(texts.slice(i, j - i).to_pylist())
                if max((int(x.max(initial=0)) for x in ids), default=0) > 0xFFFF:
                    raise ValueError("the model has ids that don't fit in 16 bits")
                tokens = [x.astype("<u2").tobytes() for x in ids]
                marks = np.frombuffer(b"".join(hashlib.sha256(t).digest()[:8] for t in tokens), "<i8")
                made = [pa.array(np.full(j - i, part, np.int32)), pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array(tokens, pa.binary()), pa.array(marks)]
                row += j - i
                yield pa.RecordBatch.from_arrays(made, names=["part", "row", "id", "n", "tokens", "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"part int, row long, id {kind}, n long, tokens binary, mark long")


def placed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """part, row and start (the place in the stream) of every encoded document, and the stream's length.

    Sorted ranges are summed where they are; the sums of the ranges before are one row per range.
    """
    order = [F.col("id").asc_nulls_last(), F.col("mark").asc(), F.col("part").asc(), F.col("row").asc()]
    ranged = docs.select("part", "row", "id", "n", "mark").repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = so_far + np.cumsum(batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), block, np.int32)), batch.column(0), batch.column(1), pa.array(ends - batch.column(2).to_numpy()), pa.array(ends)], names=["block", "part", "row", "at", "stop"])
            so_far = int(ends[-1]) if len(ends) else so_far

    within = scratch.keep(ranged.mapInArrow(run, "block int, part int, row long, at long, stop long"), "within")
    sums = within.groupBy("block").agg(F.max("stop").alias("n"))
    upto = F.sum("n").over(Window.orderBy("block"))
    sums = scratch.keep(sums.select("block", (upto - F.col("n")).alias("before"), upto.alias("upto")), "sums")
    # a row per range of the sort, which is a partition of the shuffle: sent to all
    out = within.join(F.broadcast(sums.select("block", "before")), "block").select("part", "row", (F.col("at") + F.col("before")).alias("start"))
    return out, sums.agg(F.max("upto")).first()[0] or 0


def in_place(fs, own: str, name: str) -> None:
    """Move a finished file to its name, unless another attempt of the task was faster."""
    if fs.get_file_info(name).is_file:
        fs.delete_file(own)
    else:
        fs.move(own, name)


def store_starts(starts: DataFrame, folder: str) -> DataFrame:
    """Write the starts of each part as a file of numbers, in the order of its rows; a row (part, rows) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        now, out, rows, own = -1, None, 0, f"{path}/_{uuid.uuid4().hex}"

        def close() -> Iterator[pa.RecordBatch]:
            if out:
                out.close()
                in_place(fs, own, f"{path}/{now:08d}")
                yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "rows": [rows]})

        for batch in batches:
            part, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
            for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
                if part[a] != now:
                    yield from close()
                    now, rows, out = int(part[a]), 0, fs.open_output_stream(own, compression=None)
                out.write(start[a:b].astype("<i8").tobytes())
                rows += b - a
        yield from close()

    return starts.repartition("part").sortWithinPartitions("part", "row").select("part", "start").mapInArrow(run, "part int, rows long")


def fragments(docs: DataFrame, starts: str, total: int, length: int, key: int, shard_slots: int, done: np.ndarray) -> DataFrame:
    """Encoded documents cut where sequences end: slot, shard, at (place in the sequence), id and tokens (pressed).

    Nothing is sent to shards that are ``done`` (a flag of each).
    """
    sequences = -(-total // length)
    flags = np.packbits(done).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        fs, path = open_store(starts)
        stands = np.unpackbits(np.frombuffer(flags, np.uint8)).astype(bool)
        now, begin = -1, np.zeros(0, np.int64)
        for batch in batches:
            part, row, n = (batch.column(c).to_numpy() for c in ("part", "row", "n"))
            at = np.zeros(len(n), np.int64)
            for p in np.unique(part).tolist():
                if p != now:
                    with fs.open_input_stream(f"{path}/{p:08d}", compression=None) as f:
                        now, begin = p, np.frombuffer(f.read(), "<i8")
                at[part == p] = begin[row[part == p]]
            first, last = at // length, (at + n - 1) // length
            many = np.where(n > 0, last - first + 1, 0)
            whose = np.repeat(np.arange(len(n)), many)
            number = first[whose] + np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
            slot = permute(number, sequences, key)
            keep = ~stands[slot // shard_slots] if len(slot) else np.zeros(0, bool)
            whose, number, slot = whose[keep], number[keep], slot[keep]
            a, b = np.maximum(at[whose], number * length), np.minimum(at[whose] + n[whose], (number + 1) * length)
            tokens = batch.column("tokens")
            for s in range(0, len(whose), 4096):
                c = slice(s, s + 4096)
                cut = [press.compress(memoryview(tokens[w].as_buffer())[2 * x : 2 * y]) for w, x, y in zip(whose[c].tolist(), (a - at[whose])[c].tolist(), (b - at[whose])[c].tolist(), strict=True)]
                made = [pa.array(slot[c]), pa.array(slot[c] // shard_slots), pa.array((a - number * length)[c].astype(np.int32)), batch.column("id").take(pa.array(whose[c])), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["slot", "shard", "at", "id", "tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("part", "row", "id", "n", "tokens").mapInArrow(run, f"slot long, shard long, at int, id {kind}, tokens binary")


def store_shards(pieces: DataFrame, folder: str, length: int, shard_slots: int) -> DataFrame:
    """Write shards and their index from fragments in the order of slots; a row (shard, slots) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import parquet

        fs, path = open_store(folder)
        for x in ("shards", "index"):
            fs.create_dir(f"{path}/{x}", recursive=True)
        press, own, width = zstandard.ZstdDecompressor(), uuid.uuid4().hex, length * 2
        now, out, rows = -1, None, []
        slot, parts, ids = -1, [], []  # the sequence that is being put together

        def end_sequence() -> None:
            if parts:
                data = b"".join(parts)
                out.write(data.ljust(width, b"\0"))
                rows.append((slot, now, f"{folder}/shards/{now:08d}.bin", (slot - now * shard_slots) * width, length, len(data) // 2, list(ids)))
                parts.clear()
                ids.clear()

        def end_shard() -> Iterator[pa.RecordBatch]:
            if out:
                end_sequence()
                out.close()
                schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("byte_offset", pa.int64()), ("length", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(kind))])
                table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                with fs.open_output_stream(f"{path}/index/_{own}", compression=None) as f:
                    parquet.write_table(table, f)
                in_place(fs, f"{path}/index/_{own}", f"{path}/index/{now:08d}.parquet")
                in_place(fs, f"{path}/shards/_{own}", f"{path}/shards/{now:08d}.bin")
                yield pa.RecordBatch.from_pydict({"shard": [now], "slots": [len(rows)]})

        for batch in batches:
            kind = batch.schema.field("id").type
            for s, shard, d, t in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "id", "tokens")), strict=True):
                if s != slot:
                    if shard != now:
                        yield from end_shard()
                        now, rows, out = shard, [], fs.open_output_stream(f"{path}/shards/_{own}", compression=None)
                    else:
                        end_sequence()
                    slot = s
                parts.append(press.decompress(t))
                if not ids or ids[-1] != d:
                    ids.append(d)
        yield from end_shard()

    return pieces.select("slot", "shard", "id", "tokens").mapInArrow(run, "shard long, slots long")


def finished(spark: SparkSession, folder: str, n_shards: int) -> np.ndarray:
    """By shard whether its file stands."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shards")
    fs, out = path.getFileSystem(spark._jsc.hadoopConfiguration()), np.zeros(n_shards, bool)
    if fs.exists(path):
        for f in fs.listStatus(path):
            if (name := f.getPath().getName()).endswith(".bin") and not name.startswith("_"):
                out[int(name.removesuffix(".bin"))] = True
    return out


def input_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, int]:
    """How many rows the input has, and a sum of hashes of its ids and texts that doesn't depend on their order."""
    r = docs.agg(F.count("*"), F.sum(F.xxhash64(F.col(id_col), F.col(text_col)).cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0) % (1 << 62)


def kept(spark: SparkSession, path: str) -> dict | None:
    """The one row of a small table, if it was written."""
    try:
        return spark.read.parquet(path).first().asDict()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def prepare(docs: DataFrame, model_path: str, scratch: Scratch, folder: str, rows: int, id_col: str, text_col: str) -> int:
    """Write ``encoded`` and ``starts``, and then ``ready``; returns the stream's length."""
    spark = docs.sparkSession
    encoded(docs, model_path, id_col, text_col).write.mode("overwrite").options(**PRESSED).parquet(f"{folder}/encoded")
    Scratch.delete(spark, f"{folder}/starts")
    starts, total = placed(spark.read.parquet(f"{folder}/encoded"), scratch)
    told = scratch.keep(store_starts(starts, f"{folder}/starts"), "told")
    if (n := told.agg(F.sum("rows")).first()[0] or 0) != rows:
        raise ValueError(f"{n} of {rows} documents have their place; the input has changed meanwhile")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ready")
    scratch.drop("within", "sums", "told")
    return total


def write(docs: DataFrame, model_path: str, scratch: Scratch, folder: str | None = None, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, resume: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; returns the index: slot, shard, path, byte_offset, length, n_tokens and doc_ids of each sequence.

    ``folder`` is new, or with ``resume`` that of the job which is to be carried on.
    """
    spark, folder = docs.sparkSession, (folder or scratch.path("job")).rstrip("/")
    with open(model_path, "rb") as f:
        model = hashlib.sha256(f.read()).hexdigest()
    rows, content = input_of(docs, id_col, text_col)
    job = {"model": model, "key": key, "length": length, "shard_slots": shard_slots, "documents": rows, "content": content}
    about = kept(spark, f"{folder}/about")
    if about and not resume:
        raise ValueError(f"{folder} has a job already")
    if about and (other := [k for k in job if job[k] != about[k]]):
        raise ValueError(f"{folder} has a job with other {', '.join(other)}")
    if not about:
        for x in ("ready", "encoded", "starts", "shards", "index"):
            Scratch.delete(spark, f"{folder}/{x}")
        about = job | {"tokens": prepare(docs, model_path, scratch, folder, rows, id_col, text_col)}
        kinds = "model string, key long, length int, shard_slots int, documents long, content long, tokens long"
        spark.createDataFrame([tuple(about.values())], kinds).coalesce(1).write.parquet(f"{folder}/about")
    total = about["tokens"]
    sequences = -(-total // length)
    n_shards = -(-sequences // shard_slots)
    done = finished(spark, folder, n_shards)
    index_type = f"slot long, shard long, path string, byte_offset long, length int, n_tokens int, doc_ids array<{docs.schema[id_col].dataType.simpleString()}>"
    if not done.all():
        if not kept(spark, f"{folder}/ready") and prepare(docs, model_path, scratch, folder, rows, id_col, text_col) != total:
            raise ValueError("the documents have other ids than when the job was started")
        source = spark.read.parquet(f"{folder}/encoded")
        cut = fragments(source, f"{folder}/starts", total, length, key, shard_slots, done)
        parts = min(n_shards, MOST_PARTITIONS)
        ranged = cut.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int")).sortWithinPartitions("slot", "at")
        made = scratch.keep(store_shards(ranged, folder, length, shard_slots), "made")
        if (n := made.count()) != (~done).sum():
            raise ValueError(f"{n} of {(~done).sum()} shards were written")
    for x in ("ready", "encoded", "starts"):
        Scratch.delete(spark, f"{folder}/{x}")
    return spark.read.schema(index_type).parquet(f"{folder}/index") if n_shards else spark.createDataFrame([], index_type)


def read(index: DataFrame) -> DataFrame:
    """slot, shard, byte_offset, n_tokens, doc_ids and tokens (without padding), read from the shards in slot order."""
    kind = index.schema["doc_ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, opened = None, None
        for batch in batches:
            tokens = []
            for path, at, n, width in zip(*(batch.column(c).to_pylist() for c in ("path", "byte_offset", "n_tokens", "length")), strict=True):
                if path != opened:
                    if stream:
                        stream.close()
                    fs, local = open_store(path)
                    stream, opened = fs.open_input_file(local), path
                stream.seek(at)
                data = stream.read(width * 2)
                if len(data) != width * 2:
                    raise ValueError(f"{path} ends before byte {at + width * 2}")
                tokens.append(data[: n * 2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("slot", "shard", "byte_offset", "n_tokens", "doc_ids")), pa.array(tokens, pa.binary())], names=["slot", "shard", "byte_offset", "n_tokens", "doc_ids", "tokens"])
        if stream:
            stream.close()

    return index.mapInArrow(run, f"slot long, shard long, byte_offset long, n_tokens int, doc_ids {kind}, tokens binary")
