"""Spans of pieces against the library's own offsets, for the production model and for models with a character map."""

from __future__ import annotations

import struct

import public_tokenizers

from lodestone.llm.pieces import CharMap, Codec, _fields

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "plain words here", "  two  spaces and a tab\there \n\n lines ", "Stra\u00dfe \u00c5ngstr\u00f6m na\u00efve", "\u6f22\u5b57 kana \U0001f600 end", "\u2581 bar \u2581\u2581 x \u6f22",
    "\ufb01ne of\ufb01ce \u00bd abcab \uff21\uff22", "", " ", "a", "\u6f22", "x" * 300, "ab" * 40, "tail space ", "\u00a0nbsp\u3000wide",
]
KEYS = {"\ufb01": "fi", "\uff21": "A", "\uff22": "B", "ab": "c", "abcab": "q", "\u00bd": "1/2", "\u00a0": " ", "\u3000": " ", "\u00df": "ss", "x": "xx", "\t": " "}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def compiled(keys: dict[str, str]) -> bytes:
    """A character map: every node of the trie has a block of 256 units of its own."""
    values, at, trie = bytearray(), {}, {}
    for key, value in keys.items():
        at[key] = len(values)
        values += value.encode() + b"\0"
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[-1] = at[key]
    units = [0] * 256

    def place(node: dict, unit: int) -> None:
        base = len(units)
        units.extend([0] * 256)
        units[unit] |= (unit ^ base) << 10
        if -1 in node:
            units[unit] |= 1 << 8
            units[base] = 1 << 31 | node[-1]
        for byte, child in node.items():
            if byte >= 0:
                units[base ^ byte] |= byte
                place(child, base ^ byte)

    place(trie, 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + bytes(values)


def model(charmap: bytes | None, squeeze: bool) -> bytes:
    """The production model with another normaliser."""
    out = bytearray()
    for number, value in _fields(open(PATH, "rb").read()):
        if number == 3:
            spec = (b"" if charmap is None else b"\x12" + varint(len(charmap)) + charmap) + b"\x18\x01" + (b"\x20\x01" if squeeze else b"\x20\x00") + b"\x28\x01"
            value = spec
        out += varint(number << 3 | 2) + varint(len(value)) + bytes(value)
    return bytes(out)


def library(codec: Codec, text: str) -> list[tuple]:
    """Piece and byte span of every piece, as the library has them; None for bytes of a character."""
    found = codec.model.encode(text, return_type="proto")
    return [(p.id, None if codec.model.is_byte(p.id) else (p.begin, p.end)) for p in found.pieces]


def test_the_map_is_read_as_built():
    charmap = CharMap(compiled(KEYS))
    for text in ("abcab", "abx", "a", "\ufb01x", "\u00bd"):
        data = text.encode()
        best = max((k for k in KEYS if text.startswith(k)), key=len, default="")
        assert charmap.longest(data, 0) == (len(best.encode()), KEYS.get(best, "").encode())


def test_spans_are_those_of_the_library():
    for charmap, squeeze in ((None, False), (None, True), (compiled(KEYS), False), (compiled(KEYS), True)):
        codec = Codec(model(charmap, squeeze))
        assert codec.by_parts is (charmap is None and not squeeze)
        for text in TEXTS:
            ids = codec.encode(text)
            begins, ends = codec.spans(text, ids)
            expected = library(codec, text)
            assert ids.tolist() == [i for i, _ in expected]
            source = text.encode()
            for i, a, z, (_, span) in zip(ids.tolist(), begins.tolist(), ends.tolist(), expected, strict=True):
                if span is not None:
                    inside = z > span[1] and source[span[1] : z].decode() in KEYS  # the piece ends within a replacement, all of which we give it
                    assert a == span[0] and (z == span[1] or inside), (text, codec.model.id_to_piece(i), (a, z), span)
                else:  # all bytes of a character have its span
                    key = source[a:z].decode()
                    assert len(key) == 1 or key in KEYS, (text, key)
