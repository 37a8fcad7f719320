"""Words and 64-bit word hashes of whole Arrow batches, with numpy inside Spark tasks.

Words are runs of bytes of a class; every class takes all bytes from 0x80 up, so that cutting bytes equals cutting
code points. A-Z is lower-cased first. Texts are worked on in stretches of ``STRETCH`` bytes to bound memory; a word
or text of any length is kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 19
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Words of letters, digits and all beyond ASCII.
ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
#: Words between white space.
SPACED = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LONG = 64  # bytes; longer words are few


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words given by their bytes: a scramble after every eight bytes, a cryptographic digest of long words.

    No sum over the bytes is taken, so words built from each other by a rule (doubled, swapped) have nothing to cancel.
    """
    text = np.append(LOWER[data], np.zeros(8, np.uint8))
    eights = np.ndarray(len(data), "<u8", text, strides=(1,))  # the eight bytes from every byte on
    size = end - start
    out = mixed(size.astype(np.uint64) + np.uint64(_BASE))
    at = np.flatnonzero(size <= _LONG)
    for done in range(0, _LONG, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        unused = np.maximum(8 - (size[at] - done), 0).astype(np.uint64) * np.uint64(8)
        block = eights[start[at] + done] & (np.uint64(MASK) >> unused)
        out[at] = mixed(out[at] ^ block)
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(text[start[i]:end[i]], digest_size=8).digest(), "little")
    return out


class Words(NamedTuple):
    first: int  # the batch row of the first text
    bounds: np.ndarray  # of the texts in ``hashes``: one more than there are texts
    hashes: np.ndarray  # uint64 per word


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def stretches(bounds: np.ndarray, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; at least one row each."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last bytes of the words; no word crosses a text's bound."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed(column: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """The word hashes of a string column, stretch by stretch, in the order of the text."""
    data, bounds = flat(column)
    for i, j in stretches(bounds):
        part, own = data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
        start, end = spans(part, own, kind)
        yield Words(i, np.searchsorted(start, own), _word_hashes(part, start, end))
