"""Vectorised tokenising of Arrow string columns.

Texts stay UTF-8 bytes from the scan to the result: a batch's value buffer is
read as one ``uint8`` array, word boundaries are found by comparing bytes, and
every word of the batch gets a 64-bit hash from the 8 bytes at a time that it
consists of.  Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: ``[\x20\x09-\x0D]``: what separates words unless an operator says otherwise.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return data | (((data - np.uint8(0x41)) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def _solid(data: np.ndarray, blank: np.ndarray) -> np.ndarray:
    if blank is BLANK:
        return ~((data == 0x20) | ((data - np.uint8(0x09)) < np.uint8(5)))
    return ~blank[data]


#: Bytes of text that are worked on at a time.
CHUNK = 1 << 20

#: For a word's last piece: the lowest k bytes.
_PIECE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (three xor-shifts, two multiplications)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Texts(NamedTuple):
    """Some consecutive texts: their bytes, and where each begins and ends in them."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # index of the first text in the batch


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    array = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_string() if pa.types.is_string(array.type) else array.type)
        if not pa.types.is_large_string(array.type):
            array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null("" if pa.types.is_large_string(array.type) else b"")
    _, where, values = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[Texts]:
    """Whole texts, about ``size`` bytes at a time; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def words(texts: Texts, blank: np.ndarray = BLANK) -> Words:
    """Maximal runs of bytes that ``blank`` does not hold; no run crosses two texts."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(len(offsets), np.int64))
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = _solid(data, blank)
    starts = np.flatnonzero(solid[1:-1] > solid[:-2])
    ends = np.flatnonzero(solid[1:-1] > solid[2:]) + 1
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    inner = inner[solid[inner] & solid[inner + 1]]
    if len(inner):  # a run that crosses from one text to the next is two
        starts, ends = (np.sort(np.concatenate([x, inner])) for x in (starts, ends))
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))  # the 8 bytes at each place
    size = w.ends - w.starts
    with np.errstate(over="ignore"):
        out = (eight[w.starts] & _PIECE[np.minimum(size, 8)]) * _odd(0) ^ size.astype(np.uint64) * _odd(1)
        left, done = np.flatnonzero(size > 8), 8
        while len(left):
            more = size[left] - done
            out[left] = (mix(out[left]) + (eight[w.starts[left] + done] & _PIECE[np.minimum(more, 8)])) * _odd(0)
            left, done = left[more > 8], done + 8
    return mix(out)


def _odd(k: int) -> np.uint64:
    return np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) ^ 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF | 1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (across texts too)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _odd(0)
        for k in range(1, width):
            out += hashes[k : k + n] * _odd(k)
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a shingle; its length counts."""
    return runs(hashes, len(hashes))[0]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """:func:`whole` of every run of ``n`` consecutive words (across texts too)."""
    m = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        total = np.full(m, np.uint64(n) * np.uint64(0x8EBC6AF09C88C6E3))
        for k in range(n):
            total += hashes[k : k + m] * _odd(k + 64)
    return mix(total)


def shingle_sets(texts: Texts, width: int = 5, blank: np.ndarray = BLANK) -> Iterator[np.ndarray]:
    """Of each text, its distinct ``width``-word shingles as sorted hashes.

    A text of fewer words has one shingle, the whole sequence; a text without
    words has none.
    """
    data = lower(texts.data)
    w = words(Texts(data, texts.offsets, 0), blank)
    hashes = word_hashes(data, w)
    shingles = windows(hashes, width)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(shingles[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield np.array([whole(hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
