"""Token counts that follow edits.

A document's pre-tokens are leaves of a segment tree whose nodes hold token sums. An edit re-encodes
only the leaves it touches and those on either side up to the next safe cut, replaces them in their places (a leaf may
become empty or take what a neighbour cannot), and updates the sums above them. Leaves are groups of whole pieces that begin at a space after a printable
character, which is always the beginning of a pre-token, so counts equal those of the whole text.

Null texts are empty and count 0. Edits outside the text are clipped to it; edits of a document are
applied in the order of their number, each on the text as it stands; a null replacement deletes. Edits of unknown documents
change nothing. Repeated rows of a document are counted and edited each for itself. Very long texts have a tree of many leaves, one long
unbroken run is a leaf of its own. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.llm import pieces
from clinflow.llm.pieces import PieceEncoder, as_bytes, groups

#: Characters of a leaf at least when a text is cut, and the most that a leaf grows to by edits before the tree is built again.
LEAF, LARGEST = 256, 4096
_SAFE = re.compile(r"(?<=[!-~]) ")


class TokenTree:
    """Leaves (strings) under a segment tree of token sums. count(list of strings) gives the tokens of each."""

    def __init__(self, leaves: list[str], counts: list[int] | np.ndarray, count: Callable[[list[str]], list[int]]):
        self.leaves, self.count, self.encoded = list(leaves), count, 0
        self._grow(list(map(int, counts)))

    @classmethod
    def of(cls, text: str, count: Callable[[list[str]], list[int]], leaf: int = LEAF) -> TokenTree:
        leaves = cut(text, leaf)
        return cls(leaves, count(leaves), count)

    def _grow(self, counts: list[int]) -> None:
        self.base = 1 << max(0, (max(1, len(counts)) - 1).bit_length())
        self.tokens = np.zeros(2 * self.base, np.int64)
        self.chars = np.zeros(2 * self.base, np.int64)
        self.tokens[self.base : self.base + len(counts)] = counts
        self.chars[self.base : self.base + len(counts)] = [len(x) for x in self.leaves]
        width = self.base
        while width > 1:  # a level at a time
            width //= 2
            for sums in (self.tokens, self.chars):
                sums[width : 2 * width] = sums[2 * width : 4 * width].reshape(-1, 2).sum(1)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.base, max(0, len(self.leaves) - 1)), before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters start to end (exclusive)."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        if not self.leaves:
            self.leaves = cut(replacement, LEAF)
            self.encoded += len(replacement)
            return self._grow(self.count(self.leaves))
        first, before = self.find(min(start, max(0, self.length - 1)))
        last, last_before = self.find(max(start, end - 1) if end > start else min(start, max(0, self.length - 1)))
        # the leaf before gives the left context, the leaf after begins at a space whose left neighbour may change
        if start - before < 2:
            while first > 0:
                first -= 1
                before -= len(self.leaves[first])
                if self.leaves[first]:
                    break
        left = self.leaves[last]
        while last + 1 < len(self.leaves) and (end - last_before >= len(self.leaves[last]) - 1 or not _safe(left, self.leaves[last + 1])):
            last_before += len(self.leaves[last])
            last += 1
            left = self.leaves[last] or left
        old = "".join(self.leaves[first : last + 1])
        new = cut(old[: start - before] + replacement + old[end - before :], LEAF)
        counts = self.count(new)
        self.encoded += sum(map(len, new))
        slots = last + 1 - first
        if len(new) > slots and sum(map(len, new[slots - 1 :])) <= LARGEST:  # the last leaf takes the rest
            new[slots - 1 :], counts[slots - 1 :] = ["".join(new[slots - 1 :])], [sum(counts[slots - 1 :])]
        if len(new) <= slots:  # leaves keep their places, some stay empty: only the sums above them change
            for i in range(slots):
                leaf, n = (new[i], counts[i]) if i < len(new) else ("", 0)
                if leaf or self.leaves[first + i]:
                    self.leaves[first + i] = leaf
                    self._set(first + i, n, len(leaf))
        else:  # the text has grown by more than a leaf takes
            held = [int(x) for x in self.tokens[self.base : self.base + len(self.leaves)]]
            self.leaves[first : last + 1] = new
            held[first : last + 1] = counts
            full = [i for i, x in enumerate(self.leaves) if x]
            self.leaves = [self.leaves[i] for i in full]
            self._grow([held[i] for i in full])

    def _set(self, leaf: int, tokens: int, chars: int) -> None:
        node = self.base + leaf
        by = (tokens - int(self.tokens[node]), chars - int(self.chars[node]))
        while node:
            self.tokens[node] += by[0]
            self.chars[node] += by[1]
            node //= 2


def _safe(left: str, right: str) -> bool:
    return bool(left) and "!" <= left[-1] <= "~" and right.startswith(" ")


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of at least `leaf` characters that begin at safe spaces."""
    out, at = [], 0
    while at < len(text):
        m = _SAFE.search(text, min(len(text), at + leaf))
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def counter(encoder: PieceEncoder) -> Callable[[list[str]], list[int]]:
    """Tokens of each string. A string begins and ends at safe cuts."""

    def count(texts: list[str]) -> list[int]:
        if not texts:
            return []
        arr = pa.array(texts, pa.large_string())
        return np.diff(encoder.encode(*as_bytes(arr), arr)[1]).tolist()

    return count


def count(docs: DataFrame, edits: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id_col with n_tokens, n_tokens_after, n_edits, n_reencoded_chars and text_after.

    edits: id_col and `edits`, array<struct<start_at:long, end_at:long, replacement:string>> in their order, one row per document
    with edits; offsets are code points of the text as the edits before have left it.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(edits.select(F.col(id_col).alias("_eid"), F.col("edits").alias("_edits")), F.col("_id") == F.col("_eid"), "left").drop("_eid")
    return _count(rows, tokenizer, id_col, id_type)


def count_found(docs: DataFrame, patterns: dict[str, str], tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `count`, with every match of the patterns (Python's, without groups; the leftmost first, then the first named) replaced by its pattern's name."""
    names = list(patterns)
    either = "|".join(f"({p})" for p in patterns.values())

    def find(text: str) -> list[dict]:
        found = [{"start_at": m.start(), "end_at": m.end(), "replacement": names[m.lastindex - 1]} for m in re.finditer(either, text)]
        return found[::-1]  # the last first, so that all offsets are those of the text as it was

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _count(rows, tokenizer, id_col, docs.schema[id_col].dataType.simpleString(), find)


def _count(rows: DataFrame, tokenizer: str, id_col: str, id_type: str, find: Callable[[str], list[dict]] | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.encoder(tokenizer)
        per = counter(encoder)
        for whole in batches:
            for lo, hi in groups(as_bytes(whole.column(1))[1]):
                batch = whole.slice(lo, hi - lo)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                leaves = [cut(t) for t in texts]
                flat = pa.array([x for own in leaves for x in own], pa.large_string())
                counts = np.diff(encoder.encode(*as_bytes(flat), flat)[1]).tolist()
                out, after, at = [], [], 0
                for text, own, edits in zip(texts, leaves, map(find, texts) if find else batch.column(2).to_pylist(), strict=True):
                    known = counts[at : at + len(own)]
                    at += len(own)
                    usable = [e for e in edits or () if e is not None and e["start_at"] is not None and e["end_at"] is not None]
                    if not usable:  # nothing to keep a tree for
                        out.append((sum(known), sum(known), 0, 0))
                        after.append(text)
                        continue
                    tree = TokenTree(own, known, per)
                    for e in usable:
                        tree.edit(e["start_at"], e["end_at"], e["replacement"] or "")
                    out.append((sum(known), tree.total, len(usable), tree.encoded))
                    after.append(tree.text)
                columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(4)]
                yield pa.record_batch([batch.column(0), *columns, pa.array(after, pa.string())], names=[id_col, "n_tokens", "n_tokens_after", "n_edits", "n_reencoded_chars", "text_after"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, n_tokens_after long, n_edits long, n_reencoded_chars long, text_after string")
