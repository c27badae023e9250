"""Words of texts as bytes in Arrow buffers, and CRC-32 states after runs of them, for all words of a piece at once.

A table of 256 classes lower-cases A-Z and tells word bytes (letters, digits,
all beyond ASCII) from others. Words begin and end where the class differs from
the neighbour's, and texts end at the buffer's offsets. The CRC's automaton
advances over all words a byte a step, the words ordered by length so that
those still running are a prefix; the few of over ``STEPS`` bytes end in zlib's
CRC, the same automaton. Texts are taken in pieces of about ``PIECE`` bytes,
each text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import digits

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 64
PIECE = 1 << 18  # bytes of text that are hashed together


def _class_table() -> np.ndarray:
    """Each byte in lower case if it belongs to a word (letters, digits, all beyond ASCII), else 0."""
    table = np.zeros(256, np.uint8)
    for b in [*digits.encode(), *range(ord("a"), ord("z") + 1), *range(128, 256)]:
        table[b] = b
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte's change to the state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CLASSES, CRC = _class_table(), _crc_table()
FULL = np.uint32(0xFFFFFFFF)


class Words:
    """The words of a run of texts, and the states of the CRC automaton after runs of them."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: the texts' bytes; ends: where each text ends."""
        self.bytes = CLASSES[data]
        inside = self.bytes != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
        begins[cuts] |= inside[cuts]  # a text may begin where the one before it ends in a word
        self.starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[cuts - 1] |= inside[cuts - 1]
        lengths = np.flatnonzero(stops) + 1 - self.starts
        self.text = np.searchsorted(ends, self.starts, side="right")  # the text that each word is in
        self.counts = np.bincount(self.text, minlength=len(ends))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths
        falling = lengths[self.order]
        self.running = np.searchsorted(-falling, -np.arange(1, STEPS + 1), side="right")  # words that have a byte at each step

    def advance(self, states: np.ndarray) -> np.ndarray:
        """The state of each word, given in ``states`` before it, after its bytes."""
        state, at = states[self.order], self.starts[self.order]
        for step, n in enumerate(self.running.tolist()):
            if n == 0:
                break
            now = state[:n]
            state[:n] = CRC[(now ^ self.bytes[at[:n] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
        out = np.empty_like(state)
        out[self.order] = state
        for k in self.order[: np.searchsorted(-self.lengths[self.order], -STEPS, side="left")].tolist():  # over STEPS bytes
            rest = self.bytes[self.starts[k] + STEPS : self.starts[k] + self.lengths[k]]
            out[k] = zlib.crc32(rest.tobytes(), int(out[k] ^ FULL)) ^ 0xFFFFFFFF
        return out

    def features(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(last word, CRC-32) of all runs of one word, of two, and so on."""
        state = self.advance(np.full(len(self.starts), FULL))
        fits = np.ones(len(state), bool)
        yield np.arange(len(state)), state ^ FULL
        for _ in range(longest - 1):
            before = np.full(len(state), FULL)
            spaced = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            before[1:] = spaced[:-1]
            fits[1:] = fits[:-1] & (self.text[1:] == self.text[:-1])
            fits[:1] = False
            state = self.advance(before)
            last = np.flatnonzero(fits)
            yield last, state[last] ^ FULL


def pieces_of(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """The first text's place and the words of runs of whole texts of about ``PIECE`` bytes; nulls are empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        data = np.zeros(0, np.uint8)
    else:
        data = np.frombuffer(column.buffers()[2], np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        low, high = offsets[at], offsets[to]
        yield at, Words(data[low:high], offsets[at + 1 : to + 1] - low)
        at = to


def bytes_of(text: str = "text") -> Column:
    """The text's bytes; a null is empty, so that no null slot of the buffer has bytes of its own."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
