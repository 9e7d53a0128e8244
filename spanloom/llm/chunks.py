"""Cutting of UTF-8 bytes where a tokenizer's pre-tokenizer always cuts, without a look at the words themselves.

Bytes fall into white space, letters (ASCII and the Latin letters U+00C0 to U+00FF), ASCII digits, ASCII marks, the
apostrophe, and all others. Both kinds of pre-tokenizer used here end a match where the class changes between letters, digits
and marks. They also do so before white space. After an apostrophe nothing is cut, as contractions begin
with it; next to other bytes nothing is cut either, so a chunk may hold several matches but a match never two chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x21:0x7F] = MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x27] = APOSTROPHE
_CHANGE = np.zeros(64, bool)
for _a, _b in ((LETTER, DIGIT), (LETTER, MARK), (LETTER, APOSTROPHE), (DIGIT, LETTER), (DIGIT, MARK), (DIGIT, APOSTROPHE), (MARK, LETTER), (MARK, DIGIT)):
    _CHANGE[_a * 8 + _b] = True


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte."""
    out = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs for times and divided by
    out[lead] = out[lead + 1] = LETTER
    return out


def changes(kind: np.ndarray) -> np.ndarray:
    """True at each byte where a chunk begins because the class changes."""
    out = np.zeros(len(kind), bool)
    out[1:] = _CHANGE[kind[:-1] * np.uint8(8) + kind[1:]]
    return out


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The byte strings that begin at `starts` (ascending from 0) and fill `data`, without a copy of them."""
    places = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and its len + 1 places in them. A null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs [start, start + size) one after the other, and the running count with a leading 0."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - total[:-1], sizes) + np.arange(total[-1]), total


class Known:
    """Ids of distinct chunks, numbered as they come: those of number k are flat[start[k] : start[k] + size[k]]."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> slice:
        """Take in new chunks with all their ids and the count of each; gives their numbers."""
        n = len(self.code)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(1 << 14, len(self.flat)), np.uint32)])
        while n + len(chunks) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(1 << 12, len(x)), np.int64)]) for x in (self.start, self.size))
        to = slice(n, n + len(chunks))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[to] = sizes
        self.start[to] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.code.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        return to
