"""Operator 6: a writer of dictionary-compressed WARC archives, and their reader.

Every archive starts with a skippable Zstandard frame that holds a dictionary trained from the archive's own records;
then every record is a frame of its own, compressed with the dictionary. Of records with equal payloads that with the
largest page id is the response, the others are revisits that refer to it and carry no payload.

A task holds one archive's records (``ROLL_BYTES`` of records, or one larger record) and writes it under a name of its
own in the shared folder; the manifest lists the archives of the tasks that succeeded, so files that a lost task left
are never read. Digests are taken by the engine, and only ids and digests are shuffled to find each group's response, dealt
to ``SALTS`` parts of a digest so that a hot group is not one task's. What comes back is a row per revisit; where these are
counted to be few, payloads stay where they are, else they cross the network once.

The dictionary is trained on at most ``TRAIN_BYTES`` of an archive's records, the first 128 kB of each; it shapes compression
only. Where there are fewer than 16 records to train on, their bytes themselves are the dictionary.

Defined results: null html is the empty payload; null url gives no target header. Rows that share the winning page id
are all responses; a null id never wins over another, and a group of null ids only is all responses. An empty table
gives no archive and an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, few

ROLL_BYTES, TRAIN_BYTES, DICT_BYTES, LEVEL, SALTS = 16 << 20, 2 << 20, 64 << 10, 3, 16
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D.to_bytes(4, "little")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def digest_of(payload: bytes) -> str:
    return shown(hashlib.sha1(payload, usedforsecurity=False).digest())


def shown(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, length: int, digest: str, refers: int | None, revisit: bool) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {length}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(HTTP) + len(payload)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + HTTP + payload + b"\r\n\r\n"


def train(records: list[bytes]):
    """A dictionary from records spread evenly over the archive; raw content where there are too few to train on."""
    import zstandard

    step = max(1, sum(map(len, records)) // TRAIN_BYTES)
    samples = [r[: DICT_BYTES * 2] for r in records[::step]]
    try:
        if len(samples) < 16:
            raise zstandard.ZstdError("too few")
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    own = train(records)
    own.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
    data = own.as_bytes()
    return b"".join([SKIPPABLE, len(data).to_bytes(4, "little"), data, *map(press.compress, records)])


def unpack(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    import zstandard

    if stream.read(4) != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    own = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(stream.read(4), "little")))
    text = zstandard.ZstdDecompressor(dict_data=own).stream_reader(stream, read_across_frames=True)
    left = b""
    while True:
        while (end := left.find(b"\r\n\r\n")) < 0:
            more = text.read(1 << 16)
            if not more:
                if left:
                    raise ValueError("the archive ends within a record")
                return
            left += more
        lines = left[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        need = end + 4 + int(head["Content-Length"]) + 4
        parts, have = [left], len(left)
        while have < need:
            more = text.read(max(1 << 16, need - have))
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(more)
            have += len(more)
        left = b"".join(parts)
        yield head, left[end + 4 : need - 4]
        left = left[need:]


def decisions(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """page_id, digest and winner of every page that revisits another, each once."""
    each = scratch.keep(pages.select("page_id", _digest().alias("digest"), _length().alias("length")), "digests")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS))
    part = each.groupBy("digest", salt.alias("salt")).agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    winner = part.groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n")).where("n > 1").drop("n")
    winner = winner.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # of a group only the rows that aren't the winner are told: a table of the revisits, not of the pages
    again = each.where(F.col("length") >= least_bytes).select("page_id", "digest", salt.alias("salt")).distinct()
    met = again.join(winner, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("winner")))
    return scratch.keep(met.select("page_id", "digest", "winner"), "revisits")


def _digest() -> Column:
    return F.unhex(F.sha1(F.coalesce("html", F.lit(""))))


def _length() -> Column:
    return F.octet_length(F.coalesce("html", F.lit(""))).cast("long")


def plan_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, length, digest, revisit, refers_to; payload is null for revisits."""
    again = decisions(pages, scratch, least_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "winner", F.lit(True).alias("revisit"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", _digest()).withColumn("length", _length())
    out = rows.join(F.broadcast(again) if few(again) else again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    out = out.withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    return out.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("payload"), "length", "digest", "revisit", F.col("winner").alias("refers_to"))


def write(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives into the scratch folder; returns the manifest: path, records, payload_bytes, archive_bytes."""
    folder = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        held: list[bytes] = []
        size = payloads = 0

        def flush() -> pa.RecordBatch:
            data, name = pack(held), f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{path}/{name}.part", compression=None) as out:
                out.write(data)
            store.move(f"{path}/{name}.part", f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(held)], "payload_bytes": [payloads], "archive_bytes": [len(data)]})

        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                payload = (r["payload"] or "").encode()
                held.append(record(r["page_id"], r["url"], payload, r["length"], shown(r["digest"]), r["refers_to"], r["revisit"]))
                size += len(held[-1])  # a revisit without payload takes room too
                payloads += len(payload)
                if size >= roll_bytes:
                    yield flush()
                    held, size, payloads = [], 0, 0
        if held:
            yield flush()

    return scratch.keep(plan_records(pages, scratch, least_bytes).mapInArrow(run, "path string, records long, payload_bytes long, archive_bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of all records; a wrong digest or a missing record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for uri, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, path = open_store(uri)
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in unpack(stream):
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        digest, length, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"]), head["WARC-Type"]
                        if kind == "response" and (digest_of(payload) != digest or len(payload) != length):
                            raise ValueError(f"{head['WARC-Record-ID']} in {uri} is damaged")
                        ids = [int(x) if (x := head.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        rows.append((ids[0], length, digest, kind, ids[1], payload if kind == "response" else None))
                        size += len(payload)
                        seen += 1
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema)
                            rows, size = [], 0
                if seen != expected:  # an archive can be cut between two frames
                    raise ValueError(f"{uri} has {seen} of {expected} records")
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema)

    # a number of its own, since the engine would join partitions of so few bytes into one task
    dealt = manifest.select("path", "records").repartition(max(1, min(manifest.count(), 10_000)), F.xxhash64("path"))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
