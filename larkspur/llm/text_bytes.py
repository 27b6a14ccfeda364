"""Vectorised views of UTF-8 text columns: whole Arrow batches as one byte array, lines as ranges in it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# White space beyond ASCII as UTF-8 bytes (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
TWO = [(0xC2, 0x85), (0xC2, 0xA0)]
THREE = [(0xE1, 0x9A, 0x80), *[(0xE2, 0x80, x) for x in range(0x80, 0x8B)], (0xE2, 0x80, 0xA8), (0xE2, 0x80, 0xA9), (0xE2, 0x80, 0xAF), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def white(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 32))
    rare = np.flatnonzero(np.isin(raw, [0xC2, 0xE1, 0xE2, 0xE3]))
    a = rare[rare + 1 < len(raw)]
    for x, y in TWO:
        hit = a[(raw[a] == x) & (raw[a + 1] == y)]
        out[hit] = out[hit + 1] = True
    a = rare[rare + 2 < len(raw)]
    a = a[raw[a] != 0xC2]
    code = (raw[a].astype(np.int64) << 16) | (raw[a + 1].astype(np.int64) << 8) | raw[a + 2]
    hit = a[np.isin(code, [(x << 16) | (y << 8) | z for x, y, z in THREE])]
    out[hit] = out[hit + 1] = out[hit + 2] = True
    return out


@dataclass
class Lines:
    """Lines of a batch of texts: row, number in the row (from 1), byte range without outer white space, characters in it."""

    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray


def lines(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    """Split at newlines; lines of white space only have 0 characters."""
    n = len(offsets) - 1
    if n < 1:
        return Lines(*[np.zeros(0, np.int64)] * 5)
    breaks = np.flatnonzero(raw == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    row = np.concatenate((np.arange(n), owner))
    start = np.concatenate((offsets[:-1], breaks + 1))
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    end = np.append(start[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = offsets[1:][row[last]]
    number = np.arange(len(row)) - np.searchsorted(row, row, "left") + 1
    solid = np.flatnonzero(~white(raw))
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = j > i
    first = np.where(some, solid[np.minimum(i, max(len(solid) - 1, 0))] if len(solid) else start, start)
    final = np.where(some, solid[np.maximum(j - 1, 0)] + 1 if len(solid) else start, first)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return Lines(row, number, first, final, heads[final] - heads[first])
