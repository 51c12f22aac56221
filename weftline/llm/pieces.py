"""Operator 7: SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest prefix found in the model's compiled character map, while the place
in the original bytes is noted for every normalised byte; where no entry can begin the bytes stay as they are, and a model
without a map is one without entries. Pieces are then projected to original byte spans. The normalised text is encoded by
the sentencepiece library, with the model's own normaliser switched off. Every text goes this one way.

Where no vocabulary entry has a space mark after another character, no merge crosses from one word to the
next, so the ids of a text are those of its words one after another. Each worker then keeps the ids of the
words it has met (``CACHE_WORDS`` at most, after which it starts afresh). Otherwise whole texts are encoded.

Defined results: null and empty texts have the begin and end ids only and decode to an empty text; rows are
independent, so repeated rows and ties need no rule; an empty table gives an empty result; other columns of
the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import slices, text_of

MARK = "▁"
CACHE_WORDS = 600_000


class CharMap:
    """The compiled map of a normaliser: a double-array trie, then null-terminated replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    def first_bytes(self) -> set[int]:
        """Bytes with which an entry can begin."""
        root = self.units[0] >> 10 << ((self.units[0] & 0x200) >> 6)
        return {c for c in range(1, 256) if root ^ c < len(self.units) and self.units[root ^ c] & 0x800000FF == c}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that ``data`` has at ``at``, and what replaces it."""
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found:
            return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]
        return None


class Codec:
    """Encodes and decodes with one model file; made once in each worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        self.outer = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        kind = proto.ModelProto.SentencePiece
        own = sorted((p.piece.encode() for p in model.pieces if p.type == kind.USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        first = (self.map.first_bytes() if self.map else set()) | {p[0] for p in own}
        #: Where something other than a plain character can begin.
        self.starts = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in sorted(first)) + b"]") if first else None
        model.normalizer_spec.CopyFrom(proto.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.begin, self.end, self.unk = self.outer.bos_id(), self.outer.eos_id(), self.outer.unk_id()
        pieces = [p.piece for p in model.pieces]
        # without the fast way below whole texts are encoded
        self.by_word = model.trainer_spec.model_type == proto.TrainerSpec.BPE and self.escape and not self.suffix and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.bytes_of = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.cache: dict[str, bytes] = {}

    def mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes after the map and, for each of them, its place in ``data``."""
        if not self.starts:
            return data, np.arange(len(data))
        out, at, done = [], [], 0
        for m in self.starts.finditer(data):
            k = m.start()
            if k < done:
                continue
            own = self.own and self.own.match(data, k)
            found = (own.end() - k, own[0]) if own else self.map and self.map.longest(data, k)
            if found:
                out += data[done:k], found[1]
                at += np.arange(done, k), np.full(len(found[1]), k)
                done = k + found[0]
        return b"".join([*out, data[done:]]), np.concatenate([*at, np.arange(done, len(data))])

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for the end, the place in the original bytes."""
        data = text.encode()
        end = len(data)
        out, at = self.mapped(data)
        if self.squeeze and out:
            space = np.frombuffer(out, np.uint8) == 32
            keep = ~space
            keep[1:] |= ~space[:-1]
            out, at = np.frombuffer(out, np.uint8)[keep].tobytes(), at[keep]
            if out[-1:] == b" ":
                out, at, end = out[:-1], at[:-1], int(at[-1])
        if self.dummy and out:
            out, at = (out + b" ", np.append(at, end)) if self.suffix else (b" " + out, np.append(at[:1], at))
        if self.escape:
            at = np.repeat(at, np.where(np.frombuffer(out, np.uint8) == 32, 3, 1))
            out = out.replace(b" ", MARK.encode())
        return out, np.append(at, end)

    def _words(self, texts: list[list[str]]) -> list[bytes]:
        """Joined ids of the words of each text; a mark goes before each word."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list(set().union(*texts).difference(cache))
        for w, ids in zip(new, self.inner.encode([MARK + w for w in new], num_threads=1), strict=True):
            cache[w] = array("I", ids).tobytes()
        return [b"".join(map(cache.__getitem__, words)) for words in texts]

    def _bodies(self, texts: list[str]) -> list[bytes]:
        """Ids of each normalised text, four little-endian bytes each."""
        if not self.by_word:
            return [np.array(self.inner.encode(t), "<u4").tobytes() if t else b"" for t in texts]
        heads, words = [], []
        for t in texts:
            # a word has the marks before its last one
            head, *rest = t.split(MARK) if f"{MARK}{MARK}" not in t and not t.endswith(MARK) else ("", *re.findall(f"{MARK}({MARK}*[^{MARK}]*)", t)) if t[0] == MARK else re.findall(f"^[^{MARK}]+|(?<={MARK}){MARK}*[^{MARK}]*", t)
            heads.append(np.array(self.inner.encode(head), "<u4").tobytes() if head else b"")
            words.append(rest)
        return [h + w for h, w in zip(heads, self._words(words), strict=True)]

    def aligned(self, texts: list[str]) -> list[tuple[np.ndarray, bytes, np.ndarray]]:
        """For each text its ids with begin and end id, the normalised bytes and their places."""
        norms = [self.normalised(x) for x in texts]
        ends = [np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (self.begin, self.end)]
        bodies = self._bodies([n.decode() for n, _ in norms])
        return [(np.frombuffer(ends[0] + b + ends[1], "<u4"), *n) for b, n in zip(bodies, norms, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end id."""
        return [ids for ids, _, _ in self.aligned(texts)]

    def spans(self, ids: np.ndarray, norm: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the original bytes; begin and end id are empty spans."""
        head, tail = int(self.begin >= 0), int(self.end >= 0)
        body = ids[head : len(ids) - tail]
        n = self.bytes_of[body]
        if (body == self.unk).any():
            found = self.inner.encode(norm.decode(), out_type="immutable_proto").pieces
            n = np.array([len(p.surface.encode()) or self.bytes_of[p.id] for p in found], np.int64)
            if n.sum() != len(norm):  # bytes of one character are told as one surface and empty ones
                n = np.array([self.bytes_of[p.id] if p.id != self.unk else len(p.surface.encode()) for p in found], np.int64)
        stop = np.cumsum(n)
        last = at[-1:]
        return np.concatenate([at[:1][:head] * 0, at[stop - n], last[:tail]]), np.concatenate([at[:1][:head] * 0, at[stop], last[:tail]])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: What ``encode`` can return, with Spark's types.
COLUMNS = {
    "ids": "array<int>",
    "begins": "array<long>",
    "ends": "array<long>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "covered_bytes": "long",
    "spans_sha256": "string",
}


def encode(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "begins", "ends"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with the chosen ``COLUMNS`` of its encoded text.

    begins and ends are the byte spans in the original text, covered_bytes is the end of the last span, spans_sha256 the
    digest of all begins and then all ends (little-endian, 64 bits), and decoded the library's decode(ids). A narrow stage:
    no shuffle, and memory for a slice of a batch only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, bounds = text_of(texts)
            for a, b in slices(bounds):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *rows(c, texts.slice(a, b - a).to_pylist())], names=[id_col, *columns])

    def rows(c: Codec, texts: list[str]) -> list[pa.Array]:
        found = c.aligned(texts)
        ids = [f[0] for f in found]
        spans = [c.spans(*f) for f in found] if {"begins", "ends", "covered_bytes", "spans_sha256"} & {*columns} else []
        decoded = [c.outer.decode(i.tolist()) for i in ids] if {"decoded", "decoded_sha256"} & {*columns} else []
        made = {
            "ids": lambda: pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
            "begins": lambda: pa.array([s[0] for s in spans], pa.list_(pa.int64())),
            "ends": lambda: pa.array([s[1] for s in spans], pa.list_(pa.int64())),
            "decoded": lambda: pa.array(decoded, pa.string()),
            "n_tokens": lambda: pa.array([len(i) for i in ids], pa.int64()),
            "ids_sha256": lambda: pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
            "decoded_sha256": lambda: pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            "covered_bytes": lambda: pa.array([int(s[1].max(initial=0)) for s in spans], pa.int64()),
            "spans_sha256": lambda: pa.array([hashlib.sha256(np.concatenate(s).astype("<i8").tobytes()).hexdigest() for s in spans], pa.string()),
        }
        return [made[k]() for k in columns]

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} {COLUMNS[k]}" for k in columns))
