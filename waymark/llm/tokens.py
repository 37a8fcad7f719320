"""Token ids of whole texts by a tokenizer file, with every distinct piece of a text tokenized once.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its words in a row. Words
are cut once more between an ASCII letter and closing punctuation, where the tokenizer's own pattern always cuts, and
their ASCII capitals are lower-cased first, unless a mark may follow (composition comes before lower case there) or the
stretch holds the beginning of a special token. Ids of pieces stay in a bounded store of the worker.

Fits tokenizers that lower-case, drop white space and split letters from punctuation, as ``word_bpe_49k.json`` does.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from waymark.llm.words import LOWER, SPACED, flat

STORE_WORDS = 1 << 20  # pieces kept by a worker; the store starts anew beyond that
STRETCH = 1 << 22  # bytes looked at together
_TOGETHER = 1000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b'.,;:!?)"')] = True


def pieces(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of some texts, and where each starts; ``edges`` are bytes at which a text starts."""
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    inside = SPACED[data]
    cut = np.ones(len(data) + 1, bool)  # a piece must not go on over this byte
    cut[1:-1] = ~inside[:-1] | (_LETTER[data[:-1]] & _CLOSING[data[1:]])
    cut[edges] = True
    start = np.flatnonzero(inside & cut[:-1])
    last = inside.copy()
    last[:-1] &= cut[1:-1] | ~inside[1:]
    sizes = np.flatnonzero(last) + 1 - start
    if b"<|" not in data.tobytes():
        plain = np.ones(len(data), bool)
        plain[:-1] = data[1:] < 128
        data = np.where(plain, LOWER[data], data)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside].tobytes())]), start


class TokenStore:
    """Ids of the pieces seen so far, in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids_of(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and how many each has."""
        coded = found.dictionary_encode()
        values = coded.dictionary.to_pylist()
        if len(self.place) + len(values) > STORE_WORDS:
            self.clear()
        new = [v for v in values if v not in self.place]
        if new:
            ids, counts = [self.ids], []
            for i in range(0, len(new), _TOGETHER):
                some = [v.decode("utf-8", "replace") for v in new[i:i + _TOGETHER]]
                encoded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(encoded.ids, np.int32))
                counts.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(some)))
            self.ids = np.concatenate(ids)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(counts))])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        at = np.fromiter((self.place[v] for v in values), np.int64, len(values))[coded.indices.to_numpy()]
        first, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        behind = np.cumsum(sizes)
        total = int(behind[-1]) if len(behind) else 0
        return self.ids[np.arange(total) + np.repeat(first - behind + sizes, sizes)], sizes


@lru_cache(maxsize=2)
def store(path: str) -> TokenStore:
    return TokenStore(path)


def _byte_stretches(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``STRETCH`` that end at white space or where a text ends."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + STRETCH, n)
        if end < n:
            text_end = int(bounds[np.searchsorted(bounds, end)])
            while end < text_end:
                spaces = np.flatnonzero(~SPACED[data[end:min(end + 4096, text_end)]])
                if len(spaces):
                    end += int(spaces[0])
                    break
                end = min(end + 4096, text_end)
        yield at, end
        at = end


def text_ids(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of every text of a column in order, int32; a null text has none."""
    data, bounds = flat(column)
    known, row, held = store(path), 0, []
    n = len(bounds) - 1
    for i, j in _byte_stretches(data, bounds):
        first, last = np.searchsorted(bounds, i, side="left"), np.searchsorted(bounds, j, side="left")
        found, start = pieces(data[i:j], bounds[first:last] - i)
        ids, sizes = known.ids_of(found)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = 0
        while row < n and bounds[row + 1] <= j:  # texts that end in this stretch
            end = int(upto[np.searchsorted(start, bounds[row + 1] - i)])
            yield np.concatenate([*held, ids[at:end]]) if held else ids[at:end]
            held, at, row = [], end, row + 1
        held.append(ids[at:])
    while row < n:
        yield np.concatenate(held) if held else np.zeros(0, np.int32)
        held, row = [], row + 1
