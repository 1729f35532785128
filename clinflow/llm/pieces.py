"""Byte-level BPE ids of many texts at once.

A space that follows a printable non-space character always begins a new pre-token, whatever comes
before or after, so texts are cut there; each distinct piece of a batch is encoded once and the ids are
gathered by array operations. Texts with white space outside ASCII are not cut. The ids are exactly
those of encoding each whole text.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Pieces longer than this are not remembered; beyond MOST pieces the memory starts anew.
LONG, MOST = 48, 150_000
#: A batch's texts are handled in groups of about so many bytes.
GROUP = 4_000_000
_ODD_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BEFORE = np.zeros(256, bool)
_BEFORE[0x21:0x7F] = True
_BEFORE[0x80:] = True
#: Bytes after which a joined piece may begin: the printable ASCII ones.
_INNER = [0x21 <= b <= 0x7E for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (nulls as empty) and the n + 1 offsets into them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rest() -> None:
    """Give memory that a finished task has left back, as the worker process stays and serves other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def groups(offsets: np.ndarray, most: int = GROUP) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(end, n)))
        at = out[-1][1]
    return out


def _byte_ranks(tokenizer: Tokenizer) -> dict[bytes, int]:
    """The vocabulary as bytes. Byte-level files write a byte that is no printable Latin-1 character as the next free code point from 256 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {bytes(of[c] for c in word): i for word, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in of for c in word)}


#: Fixed value: how byte-level files of this kind divide a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Is encoded in both ways when an encoder is made.
PROBE = "It's we'll 12345 x9 -- naïve größer\tein\n\n  zwei   drei. 你好 😀!? don't\r\nA_b=(c) \u00a0 end "


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = MOST, special: bool = True) -> PieceEncoder:
    """The process's encoder for a tokenizer file; what it remembers (about `most` pieces) serves all tasks of the process."""
    return PieceEncoder(path, most, special)


class PieceEncoder:
    """Encodes texts with the byte-level tokenizer file at `path`.

    Unknown pieces are joined and merged in one call; as every joined piece begins at a safe cut, the ids fall
    apart at the pieces' bounds. Pieces at a text's bounds, and those with a special token's string, go through the
    tokenizer one by one. special: that string is the special token's id, as in a plain call; else it is ordinary text.
    """

    def __init__(self, path: str, most: int = MOST, special: bool = True):
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        ranks = _byte_ranks(self.tokenizer)
        ranks = {b: i for b, i in ranks.items() if len(b) == 1 or not b.startswith(b"<|")}
        self.joined = tiktoken.Encoding("joined", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.bytes_of[i] = len(b)
        self._forget()
        if (own := self.tokenizer.encode(PROBE, add_special_tokens=False).ids) != self.joined.encode_ordinary(PROBE):
            raise ValueError(f"{path} divides or merges texts in another way than PATTERN and its ranks: {own}")

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.rows = 0

    def _put(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Adds rows; the first one's number."""
        need, row = self.used + len(ids), self.rows
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        if row + len(sizes) > len(self.first):
            more = np.zeros(row + 2 * len(sizes), np.int64)
            self.first, self.size = np.concatenate([self.first[:row], more]), np.concatenate([self.size[:row], more])
        self.flat[self.used : need] = ids
        self.first[row : row + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[row : row + len(sizes)] = sizes
        self.used, self.rows = need, row + len(sizes)
        return row

    def _rows(self, pieces: list[bytes]) -> np.ndarray:
        """Rows of the table of ids, adding what it lacks."""
        if self.rows > self.most:
            self._forget()
        out = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(out < 0)
        if not len(lacking):
            return out
        lack = [pieces[i] for i in lacking]
        inner = np.fromiter((p[0] == 32 and _INNER[p[-1]] for p in lack), bool, len(lack))
        for mark in self.marks:
            inner &= ~np.fromiter((mark in p for p in lack), bool, len(lack))
        parts = [p for p, own in zip(lack, inner, strict=True) if own]
        if parts:
            ids = np.array(self.joined.encode_ordinary(b"".join(parts).decode("utf-8", "replace")), np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))) + 1
            row = self._put(ids, np.diff(ends, prepend=0))
            out[lacking[inner]] = row + np.arange(len(parts))
        parts = [p for p, own in zip(lack, inner, strict=True) if not own]
        if parts:
            got = [self.tokenizer.encode(p.decode("utf-8", "replace"), add_special_tokens=False).ids for p in parts]
            row = self._put(np.array([i for g in got for i in g], np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
            out[lacking[~inner]] = row + np.arange(len(parts))
        self.known.update((p, r) for p, r in zip(lack, out[lacking].tolist(), strict=True) if len(p) <= LONG)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, texts: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts' ids. texts: the same texts, if they may hold white space outside ASCII."""
        starts, whose = self.cuts(data, offsets, texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        rows = self._rows(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        sizes = self.size[rows]
        ids = self.flat[ragged(self.first[rows], sizes)]
        per_text = np.bincount(whose, sizes, len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray, texts: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and the text of each."""
        lengths = np.diff(offsets)
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[1:] = (data[1:] == 32) & _BEFORE[data[:-1]]
        if texts is not None and len(texts):
            odd = pc.match_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), _ODD_SPACE)
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][lengths > 0]] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(offsets, starts, "right") - 1
