"""Words of many texts at once: runs of bytes of one class, found by array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z lower-cased and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def inside(outside: bytes) -> np.ndarray:
    """Which bytes belong to words, given those that do not."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


class Words:
    """The words of a group of texts: `codes` into `known` (the distinct words, exact), the text and the first byte of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        within = table[data]
        begins = within.copy()
        if n:
            first = np.zeros(n + 1, bool)
            first[offsets] = True
            begins[1:] &= ~within[:-1] | first[1:n]
        self.at = np.flatnonzero(begins)
        self.text = np.searchsorted(offsets, self.at, "right") - 1
        letters = LOWER[data[within]]
        before = np.cumsum(within, dtype=np.int32 if n < 1 << 31 else np.int64)
        bounds = np.append(before[self.at] - 1, len(letters)).astype(np.int64)
        self.ends = self.at + np.diff(bounds)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.at), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        self.known = found.dictionary
        self.codes = found.indices.to_numpy().astype(np.int64)
