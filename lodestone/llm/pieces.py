"""SentencePiece encoding and decoding that keeps offsets into the source.

Text is normalised by the model's compiled character map: at each place the
longest key of its trie is replaced, and every normalised byte records the
bytes of the source that it came from. The sentencepiece library segments; each
piece is then projected through this alignment to a byte span of the source. A
map without keys, like the production model's, replaces nothing, so its
alignment is laid out for the whole text at once instead of place by place.

A model whose map is empty and that keeps white space as it is (``by_parts``)
lets a text be cut where no piece can reach across: before spaces and line
breaks. Parts are encoded once and kept, which changes no id; other models are
encoded text by text.

Nulls and edges: a null text is an empty one, with no ids and an empty decoded
text; bytes that no piece has fall back to byte pieces, all with the span of
their character; the space that the model puts before a text has an empty span;
nothing is truncated; rows with a null doc_id and rows that repeat a doc_id are
rows like any other; an empty table gives an empty result; columns other than
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import map_arrow

SPACE = "▁"
RUNS = re.compile(r" *[^ ]+| +$")
CACHE = 800_000
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie of keys and a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.values = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key at ``at`` and its replacement; length 0 if there is none."""
        units, found = self.units, (0, b"")
        if not units:
            return found
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & (1 << 31 | 0xFF) != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.values[start : self.values.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Normalisation as the model's specification says, with the source byte of every normalised byte."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next(v for k, v in _fields(model) if k == 3)))
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.space = SPACE.encode() if self.escape else b" "

    def __call__(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every normalised byte, the first source byte that it came from and the byte after the last."""
        return self._all(source) if not self.map.units and not self.squeeze else self._each(source)

    def _all(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The alignment where nothing is replaced but spaces: a byte comes from its character."""
        data = np.frombuffer(source, np.uint8)
        start = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(np.r_[start, len(data)])
        wide = np.where(data[start] == 0x20, len(self.space), size) if len(start) else size
        lead = np.zeros(len(self.space) if self.prefix and source else 0, np.int64)
        return np.r_[lead, np.repeat(start, wide)], np.r_[lead, np.repeat(start + size, wide)]

    def _each(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        out, first, after = bytearray(), [], []
        i, lead = 0, True

        def put(text: bytes, a: int, z: int) -> None:
            out.extend(text)
            first.extend([a] * len(text))
            after.extend([z] * len(text))

        if self.prefix and not self.squeeze and source:
            put(self.space, 0, 0)
        while i < len(source):
            n, text = self.map.longest(source, i)
            if not n:
                n = 1 if source[i] < 0x80 else 2 if source[i] < 0xE0 else 3 if source[i] < 0xF0 else 4
                text = source[i : i + n]
            if self.squeeze:
                text = re.sub(rb" +", b" ", text)
                if lead:
                    text = text.lstrip(b" ")
            if text:
                lead = text.endswith(b" ")
                if not out and self.prefix and self.squeeze:
                    put(self.space, i, i)
                put(text.replace(b" ", self.space), i, i + n)
            i += n
        if self.squeeze:
            while out.endswith(self.space) and len(out) > len(self.space) * self.prefix:
                del out[-len(self.space) :], first[-len(self.space) :], after[-len(self.space) :]
        return np.array(first, np.int64), np.array(after, np.int64)


class Codec:
    """Encodes and decodes whole texts; kept parts make repeated words cheap."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(model)
        spec = self.normalize
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lengths = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int32)
        self.barred = np.array([p.startswith(SPACE) for p in pieces])
        crosses = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        byte_fallback = self.model.is_byte(self.model.piece_to_id("<0x0A>"))
        self.by_parts = not spec.map.units and spec.prefix and not spec.squeeze and spec.escape and byte_fallback and not crosses
        self.newline, self.bar = self.model.piece_to_id("<0x0A>"), self.model.piece_to_id(SPACE)
        self.parts: dict[str, bytes] = {}

    def _learn(self, keys: list[str]) -> None:
        """Ids of new parts. A part stands for a space and itself, or for the line break that it begins with and itself.

        Parts without spaces are encoded as one text and told apart by the bar that begins each.
        """
        plain = [k for k in keys if k and " " not in k]
        ids = np.array(self.model.encode(" ".join(plain)), np.int32)
        starts = [*np.flatnonzero(self.barred[ids]).tolist(), len(ids)]
        raw = ids.tobytes()
        for key, a, b in zip(plain, starts[:-1], starts[1:], strict=True):
            self.parts[key] = raw[4 * (a + (key[0] == "\n")) : 4 * b]  # a bar before a line break is the joint's
        for key in keys:
            if key not in self.parts:
                own = [self.bar] if not key else self.model.encode(key)[key[0] == "\n" :]
                self.parts[key] = np.array(own, np.int32).tobytes()

    def _keys(self, text: str) -> list[str]:
        keys: list[str] = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" not in words[1:] and (i or words[0]):
                keys.append("\n" + words[0] if i else words[0])
                keys += words[1:]
                continue
            if i:
                head = line[: len(line) - len(line.lstrip(" "))] and "" or words[0]
                keys.append("\n" + head)
                line = line[len(head) :]
                keys += [r[1:] for r in RUNS.findall(line)]
            else:
                keys += [r[1:] for r in RUNS.findall(" " + line)]
        return keys

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_parts or SPACE in text or "\0" in text:
            return np.array(self.model.encode(text), np.int32)
        keys = self._keys(text)
        new = set(keys).difference(self.parts)
        if new:
            if len(self.parts) + len(new) > CACHE:
                self.parts.clear()
                new = set(keys)
            self._learn(list(new))
        return np.frombuffer(b"".join(map(self.parts.__getitem__, keys)), np.int32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last, in the source, of every piece."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        first, after = self.normalize(text.encode())
        stop = np.cumsum(self._sizes(text, ids))
        return first[np.r_[0, stop[:-1]]].astype(np.int32), after[stop - 1].astype(np.int32)

    def _sizes(self, text: str, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        unknown = self.model.unk_id()
        if (ids == unknown).any():
            pieces = self.model.encode(text, out_type=str)
            sizes = np.array([len(p.encode()) if i == unknown else s for p, i, s in zip(pieces, ids, sizes, strict=True)])
        return sizes


@lru_cache(maxsize=1)
def codec(model: bytes) -> Codec:
    """One a Python worker, so that later tasks find the parts of earlier ones."""
    return Codec(model)


def model_bytes(path: str) -> bytes:
    """The model, read where the job is planned and sent with it."""
    with open(path, "rb") as f:
        return f.read()


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, as what comes of a text is several times as large."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Every row's ``ids``, byte spans ``begins``/``ends`` in the source text, and ``decoded`` text."""
    model = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in _small(batches):
            out = []
            for text in b.column(1):
                source = text.as_py() or ""
                ids = own.encode(source)
                out.append((ids, *own.spans(source, ids), own.model.decode(ids.tolist())))
            ids, begins, ends, decoded = zip(*out, strict=True) if out else ((),) * 4
            lists = [pa.array(c, pa.list_(pa.int32())) for c in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``encode`` reduced, in the same pass, to counts and digests of its ids and decoded text.

    ``spans_ok``: every span begins where the one before it ends or, for bytes of one
    character, where that begins, from the first byte of the text to its last.
    """
    model = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        digits = [str(i) for i in range(own.model.get_piece_size())]
        for b in batches:
            rows = []
            for text in b.column(1):
                source = text.as_py() or ""
                ids = own.encode(source)
                begins, ends = own.spans(source, ids)
                whole = not len(ids) or bool(begins[0] == 0 and ends[-1] == len(source.encode()) and ((begins[1:] == ends[:-1]) | (begins[1:] == begins[:-1])).all())
                listed = ids.tolist()
                joined = ",".join([digits[i] for i in listed])
                rows.append((len(listed), *(hashlib.sha256(x.encode()).hexdigest() for x in (joined, own.model.decode(listed))), whole))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_ok"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_ok boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
