"""Packing token sequences into windows, online and in bounded space.

Each partition reads its documents once and keeps a fixed number of open windows. A document's tokens
fill whole windows first; what is left goes to the open window with the least room that still takes it.
When none does and all are open, the fullest is topped up with the head of the piece and emitted. At
the partition's end the open windows are merged, cut where a window fills up, so that no more than one
window per partition is padded. There is no shuffle, and a lost task repeats the same windows.

A null text is empty; an empty document is its end token alone. Repeated rows are packed once each.
An empty table gives no sequences. Other columns are ignored, whatever their names. Very long texts fill windows of their own
and only their last piece waits. Ties between windows go to the one opened first. The string of a special token is that token's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clinflow.llm import pieces
from clinflow.llm.pieces import as_bytes, groups, rest

#: Tokens of a window, open windows of a partition, the id that ends each document.
WINDOW, OPEN, END_ID = 1024, 32, 0
#: Rows of a batch handed back.
BATCH = 4096


class Windows:
    """Open windows; pieces are (document, start, length) and emit(list of pieces) gets each closed window."""

    def __init__(self, emit, size: int = WINDOW, most: int = OPEN):
        self.emit, self.size, self.most = emit, size, most
        self.open: list[list[tuple[int, int, int]]] = []
        self.room: list[int] = []

    def add(self, doc: int, tokens: int) -> None:
        at = 0
        while tokens - at >= self.size:
            self.emit([(doc, at, self.size)])
            at += self.size
        while at < tokens:
            left = tokens - at
            best = min((r, i) for i, r in enumerate(self.room) if r >= left)[1] if any(r >= left for r in self.room) else -1
            if best < 0 and len(self.room) < self.most:
                self.open.append([])
                self.room.append(self.size)
                best = len(self.room) - 1
            if best < 0:
                best = min(range(len(self.room)), key=self.room.__getitem__)
            take = min(left, self.room[best])
            self.open[best].append((doc, at, take))
            self.room[best] -= take
            at += take
            if not self.room[best]:
                self.emit(self.open.pop(best))
                self.room.pop(best)

    def close(self) -> None:
        """Merge what is open: windows are filled in turn, so only the last can have room."""
        window, room = [], self.size
        for pieces in sorted(self.open, key=lambda p: -sum(n for _, _, n in p)):
            for doc, start, n in pieces:
                while n:
                    take = min(n, room)
                    window.append((doc, start, take))
                    start, n, room = start + take, n - take, room - take
                    if not room:
                        self.emit(window)
                        window, room = [], self.size
        if window:
            self.emit(window)
        self.open, self.room = [], []


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Pieces: id_col, start, length, ids (little-endian unsigned 32-bit, as binary), doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file that every executor has. sequence_id is unique over the table.
    """
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("_id", to_arrow_type(id_type)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.encoder(tokenizer)
        part = TaskContext.get().partitionId() << 36
        tokens: dict[int, tuple[object, np.ndarray]] = {}  # of documents with pieces in open windows
        out: list[list] = [[] for _ in schema]
        count = 0

        def emit(held: list[tuple[int, int, int]]) -> None:
            nonlocal count
            offset = 0
            for doc, start, n in held:
                key, ids = tokens[doc]
                for column, value in zip(out, (key, start, n, ids[start : start + n].tobytes(), len(ids), part + count, offset), strict=True):
                    column.append(value)
                offset += n
            count += 1

        def ready() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for c in out:
                c.clear()
            return got

        windows, number = Windows(emit, window, open_windows), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            data, offsets = as_bytes(texts)
            for lo, hi in groups(offsets):
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], texts.slice(lo, hi - lo))
                for i in range(hi - lo):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    tokens[number] = (keys[lo + i], own)
                    windows.add(number, len(own))
                    number += 1
                held = {doc for pieces in windows.open for doc, _, _ in pieces}
                tokens = {d: tokens[d] for d in held}
                if len(out[0]) >= BATCH:
                    yield ready()
        windows.close()
        yield ready()
        rest()

    rows = docs.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text")
    return rows.mapInArrow(run, f"_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("_id", id_col)
