"""Removal of passages that also start earlier, by merging the Burrows-Wheeler transforms of shards.

Texts are UTF-8 bytes. A byte goes if a string of `width` bytes that covers it also starts earlier: in a document
of a smaller id, or earlier in the same one. Strings are judged on the input and never cross documents.

1. Dictionary. Each string of `width` bytes has one anchor, the leftmost of its GRAM-byte substrings with the least
   hash, so equal strings have equal anchors at equal places. Strings that share an anchor are one stretch of
   text. Stretches are dealt by their anchor's content. An anchor's content that stands in one place alone cannot
   lie in a repeat, and equal stretches are one entry of the dictionary that keeps its earliest place.
2. Shard transforms. Entries that share an anchor with another entry are read again, and each shard (some
   megabytes of entries in one task) sorts the suffixes of its own entries once and writes its transform, divided
   by anchor. A transform of some of the entries is a subsequence of the transform of all of them.
3. Merge. The transforms of a part are interleaved by refinement. At first the shards' suffixes stand one shard
   after the other in one block. A round reads the next seven symbols of each suffix along its own shard's transform
   and interleaves the block's runs by them; blocks fall apart, and where two suffixes part their common prefix is
   known. A block of one suffix is settled. Shards' suffixes are never sorted again and no text is read. Blocks that
   hold together for `width` bytes are the repeated intervals; all but their earliest place are removed.

An anchor whose content has very many different stretches is dealt by more of the text around it (PIECES), down to
the whole string, so no part grows with a frequent line. Equal stretches are brought down to one for each shard
before they are dealt. Documents are written once, bucketed by row, and never shuffled again.

Null text counts as empty, a null id is smaller than all others, rows of one id count in one fixed order. A
text of any length is read whole. Texts below `width` bytes stay. An empty table gives an empty result. Ids are whole
numbers. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.llm.hashing import mixed
from clinflow.llm.pieces import as_bytes, groups, ragged, rest
from clinflow.shared import materialise, new_path

#: Bytes of an anchor. The low 32 bits of the number that is least hold its place, so that ties go to the left.
GRAM = 40
_PLACE = np.uint64(32)
#: Bytes of text worked on at once; stretches collected before they are dealt; text bytes for each part of the dictionary and of the table of documents.
GROUP, FLUSH, PART, BUCKET = 3_000_000, 300_000, 12_000_000, 24_000_000
#: Bytes of entries in a shard, and of transforms in a part.
SHARD, MERGE = 2_000_000, 1_500_000
#: (different stretches of an anchor beyond which, pieces that its places in a string are then cut to).
PIECES = [(2_000, 8), (20_000, 1 << 20)]
#: Symbols in a word: nine bits each, 0 is the end of an entry.
SYMBOLS = 7
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_R), -1, 1 << 64))
NONE = np.iinfo(np.int64).min


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, out=out)


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """First and last string of each stretch, its anchor, hashes of the anchor's content and of the whole stretch, its text."""
    n, gram = len(data), min(GRAM, width)
    span = width - gram + 1
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    with np.errstate(over="ignore"):
        up, down = _powers(_R, n), _powers(_BACK, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        del up
        content = mixed((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
        least = (content >> _PLACE << _PLACE) | np.arange(len(content), dtype=np.uint64)
        done = 1
        while done * 2 <= span:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < span:
            least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
        sizes = np.diff(offsets)
        whole = sizes >= width
        first = ragged(offsets[:-1][whole], sizes[whole] - width + 1)
        anchor = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(first):
            return stretches(data[:0], offsets[:1], width)
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)))
        lo, hi = first[new], first[np.append(new[1:], len(first)) - 1]
        at = anchor[new]
        # strings of neighbouring documents can have one anchor only by chance of place, so documents are told apart by `first`
        stretch = mixed((sums[hi + width] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _R)
    return lo, hi, at, content[at], stretch, np.searchsorted(offsets, lo, "right") - 1


_PLACES = [("key", np.uint64), ("stretch", np.uint64), ("id", np.int64), ("row", np.int64), ("lo", np.uint32), ("n", np.uint32), ("at", np.uint32)]
_DEALT = "part int, " + ", ".join(f"`{name}` binary" for name, _ in _PLACES)


def _blob(part: int, columns: dict[str, np.ndarray], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([columns[name].astype(t).tobytes()], pa.binary()) for name, t in kinds]], ["part", *[name for name, _ in kinds]])


def _column(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows[name]] or [np.zeros(0, kind)])


def _earliest(c: dict[str, np.ndarray], *keys: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns ordered by the keys and then by place; which rows are the first of their keys."""
    order = np.lexsort((c["lo"], c["row"], c["id"], *[c[k] for k in reversed(keys)]))
    c = {name: x[order] for name, x in c.items()}
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= c[k][1:] != c[k][:-1]
    return c, new


def _deal(width: int, parts: int):
    """The stretches of a task's texts, dealt by the content of their anchors. Equal stretches are one; the others are settled and go to a part below 0 to be passed on."""

    def flush(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        c, first = _earliest({name: np.concatenate([h[name] for h in held]) for name, _ in _PLACES}, "key", "stretch")
        again = {name: x[~first] for name, x in c.items()}
        c = {name: x[first] for name, x in c.items()}
        part = (c["key"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            yield _blob(int(p), {name: x[at] for name, x in c.items()}, _PLACES)
        if len(again["row"]):
            yield _blob(-1 - int(again["row"][0] % parts), again, _PLACES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = as_bytes(batch.column("_text"))
            rows = batch.column("_row").to_numpy()
            ids = pc.fill_null(batch.column("_id"), NONE).to_numpy()
            for i, j in groups(offsets, GROUP):
                o = offsets[i : j + 1]
                lo, hi, at, key, stretch, text = stretches(data[o[0] : o[-1]], o - o[0], width)
                start = o[text] - o[0]
                held.append({"key": key, "stretch": stretch, "id": ids[i + text], "row": rows[i + text], "lo": lo - start, "n": hi - lo + 1, "at": at - lo})
                n += len(lo)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)
        rest()

    return deal


_FOUND = "_row long, _lo long, _n int, _at int, _pieces int"


def _settle(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one part: stretches that are equal to an earlier one (_pieces 0), and the earliest of those that share their anchor with another stretch."""
    c = {name: _column(rows, name, kind) for name, kind in _PLACES}
    if key[0].as_py() < 0:
        again, pieces = np.ones(len(c["key"]), bool), np.zeros(len(c["key"]), np.int64)
    else:
        order = np.argsort(c["key"])
        sorted_keys = c["key"][order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
        c = {name: x[order[same[1:] | same[:-1]]] for name, x in c.items()}
        c, first = _earliest(c, "key", "stretch")
        group = np.cumsum(np.append(True, c["key"][1:] != c["key"][:-1])) - 1 if len(first) else np.zeros(0, np.int64)
        different = np.bincount(group, first)[group] if len(first) else np.zeros(0)
        pieces = np.ones(len(first), np.int64)
        for beyond, cut in PIECES:
            pieces[different > beyond] = cut
        pieces[~first] = 0
        again = ~first | (different > 1)
    whole = lambda name, kind: pa.array(c[name][again].astype(kind))
    return pa.table([whole("row", np.int64), whole("lo", np.int64), whole("n", np.int32), whole("at", np.int32), pa.array(pieces[again].astype(np.int32))], ["_row", "_lo", "_n", "_at", "_pieces"])


def words(symbols: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next SYMBOLS symbols from each position along `follows` in one number, and the position after them. The end of an entry follows itself."""
    two, n2 = symbols << 9 | symbols[follows], follows[follows]
    four, n4 = two << 18 | two[n2], n2[n2]
    six, n6 = four << 18 | two[n4], n4[n2]
    return six << 9 | symbols[n6], n6[follows]


def transform(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all entries in order, as (entry, place in it), and the byte before each (0 before the first). Equal suffixes stand in the order of their entries."""
    sizes = np.array([len(e) + 1 for e in entries])
    stops = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b"\0".join(entries) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[stops] = 0
    n = len(symbols)
    follows = np.arange(1, n + 1)
    follows[stops] = stops
    word, step = words(symbols, follows)
    order = np.argsort(word)
    order[: len(stops)] = stops  # only ends have the word 0
    sorted_words = word[order]
    new = np.append(True, sorted_words[1:] != sorted_words[:-1])
    new[: len(stops) + 1] = True
    rank = np.empty(n, np.int64)
    while True:
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        open_slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_slots):
            break
        these = order[open_slots]
        key = rank[these] * n + rank[step[these]]
        inner = np.argsort(key)
        order[open_slots], key = these[inner], key[inner]
        new[open_slots[1:]] |= key[1:] != key[:-1]
        step = step[step]
    entry = np.searchsorted(stops, order)
    place = order - (stops - sizes + 1)[entry]
    before = np.where(place > 0, symbols[order - 1] - 1, 0).astype(np.uint8)
    return entry, place, before


_ENTRIES = [("id", np.int64), ("row", np.int64), ("lo", np.uint32), ("n", np.uint32), ("whole", np.uint32)]
_SHARD = "part int, " + ", ".join(f"`{name}` binary" for name, _ in _ENTRIES) + ", bwt binary"


def _shards(width: int, parts: int):
    """Transforms of the wanted stretches of a task's texts, one row for each shard and part. whole: where in the transform an entry's own suffix stands."""

    def flush(entries: list[bytes], part: list[int], place: dict[str, list[int]], again: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        if not entries:
            return
        if again["row"]:
            settled = {name: np.array(x, np.int64) for name, x in again.items()} | {"whole": np.zeros(0)}
            one = _blob(-1 - again["row"][0] % parts, settled, _ENTRIES)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([b""], pa.binary())], [*one.schema.names, "bwt"])
        entry, at, before = transform(entries)
        of_entry = np.array(part)
        columns = {name: np.array(x, np.int64) for name, x in place.items()}
        order = np.argsort(of_entry[entry], kind="stable")
        bounds = np.searchsorted(of_entry[entry][order], np.arange(parts + 1))
        by_part = np.argsort(of_entry, kind="stable")
        edges = np.searchsorted(of_entry[by_part], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            mine, mine_at = order[bounds[p] : bounds[p + 1]], by_part[edges[p] : edges[p + 1]]
            own = np.flatnonzero(at[mine] == 0)
            whole = own[np.argsort(entry[mine][own])]
            got = {name: x[mine_at] for name, x in columns.items()} | {"whole": whole}
            one = _blob(int(p), got, _ENTRIES)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([before[mine].tobytes()], pa.binary())], [*one.schema.names, "bwt"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = width - min(GRAM, width) + 1
        lists = lambda: {"id": [], "row": [], "lo": [], "n": []}
        (entries, part, place, again), cut, size = ([], [], lists(), lists()), {}, 0
        for batch in batches:
            rows, ids = batch.column("_row").to_pylist(), pc.fill_null(batch.column("_id"), NONE).to_pylist()
            for row, i, text, wanted in zip(rows, ids, batch.column("_text"), batch.column("_wanted"), strict=True):
                data = text.as_buffer().to_pybytes()
                wanted = wanted.values
                for lo, n, at, pieces in zip(*[wanted.field(k).to_pylist() for k in range(4)], strict=True):
                    cuts = min(pieces, span)
                    for k in range(cuts):
                        # places of the anchor in a string, from x to y, and the strings that have it there
                        x, y = -(-k * span // cuts), -(-(k + 1) * span // cuts) - 1
                        first, last = max(0, at - y), min(n - 1, at - x)
                        if first > last:
                            continue
                        here = data[lo + first : lo + last + width]
                        own = (i, row, lo + first, last - first + 1)
                        if cuts > 1:  # different stretches may have equal pieces: the shard keeps the earliest
                            old = cut.setdefault(here, len(entries))
                            if old < len(entries):
                                held = tuple(x[old] for x in place.values())
                                for name, early, late in zip(place, min(own, held), max(own, held), strict=True):
                                    place[name][old] = early
                                    again[name].append(late)
                                continue
                        common = data[lo + at - x : lo + at - y + width]
                        entries.append(here)
                        part.append(xxhash.xxh64_intdigest(common) % parts)
                        for name, value in zip(place, own, strict=True):
                            place[name].append(value)
                        size += len(here)
                if size >= SHARD or len(again["row"]) >= SHARD:
                    yield from flush(entries, part, place, again)
                    (entries, part, place, again), cut, size = ([], [], lists(), lists()), {}, 0
        yield from flush(entries, part, place, again)
        rest()

    return shards


class Transforms:
    """Transforms of several shards one after the other: for each suffix its first symbol and the suffix without it."""

    def __init__(self, transforms: list[np.ndarray], wholes: list[np.ndarray]):
        sizes = [len(b) for b in transforms]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.symbols = np.zeros(self.base[-1], np.int64)
        self.follows = np.arange(self.base[-1])
        for base, bwt, whole in zip(self.base, transforms, wholes, strict=False):
            inner = np.ones(len(bwt), bool)
            inner[whole] = False
            inner = np.flatnonzero(inner)
            inner = inner[np.argsort(bwt[inner], kind="stable")]  # the suffixes by the byte before them: the order of those one byte longer
            at = slice(base + len(whole), base + len(bwt))
            self.follows[at] = base + inner
            self.symbols[at] = bwt[inner].astype(np.int64) + 1
        self.whole = np.concatenate([base + w for base, w in zip(self.base, wholes, strict=False)] or [np.zeros(0, np.int64)])


def interleave(shards: Transforms, suffixes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first `width` bytes, and the common prefix of each with the one before it (at most width, 0 for the first).

    suffixes: ascending, that is shard after shard and ordered within each. Refined until every block holds one suffix or agrees in `width` bytes.
    """
    word, step = words(shards.symbols, shards.follows)
    order = np.arange(len(suffixes))
    common = np.full(len(suffixes), width, np.int64)
    common[:1] = 0
    slots, block, at = np.arange(len(suffixes)), np.zeros(len(suffixes), np.int64), suffixes.copy()
    for depth in range(0, width, SYMBOLS):
        if not len(slots):
            break
        seen = word[at]
        if width - depth < SYMBOLS:
            seen = seen >> 9 * (SYMBOLS - (width - depth))
        # runs of a block stay in their shards' order: both sorts are stable
        moved = np.argsort(seen, kind="stable")
        moved = moved[np.argsort(block[moved], kind="stable")]
        order[slots] = order[slots][moved]
        seen, at = seen[moved], step[at[moved]]
        parted = np.flatnonzero((block[1:] == block[:-1]) & (seen[1:] != seen[:-1])) + 1
        differ, symbols = seen[parted] ^ seen[parted - 1], min(SYMBOLS, width - depth)
        common[slots[parted]] = depth + sum((differ >> 9 * k == 0).astype(np.int64) for k in range(symbols))
        starts = np.append(True, (block[1:] != block[:-1]) | (seen[1:] != seen[:-1]))
        single = starts & np.append(starts[1:], True)
        block = np.cumsum(starts)[~single]
        slots, at = slots[~single], at[~single]
    return order, common


def _merge(width: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Strings of one part that also start earlier: _row, _lo, _n."""
        c = {name: _column(rows, name, kind).astype(np.int64) for name, kind in _ENTRIES}
        if key[0].as_py() < 0:
            return pa.table([pa.array(c["row"]), pa.array(c["lo"]), pa.array(c["n"].astype(np.int32))], ["_row", "_lo", "_n"])
        shards = Transforms([np.frombuffer(x.as_py(), np.uint8) for x in rows["bwt"]], [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in rows["whole"]])
        entry, place, suffix = [], [], []
        at, who = shards.whole, np.arange(len(shards.whole))
        for j in range(int(c["n"].max())):
            going = c["n"][who] > j
            who, at = who[going], at[going]
            entry.append(who)
            place.append(np.full(len(who), j))
            suffix.append(at)
            at = shards.follows[at]
        entry, place, suffix = (np.concatenate(x) for x in (entry, place, suffix))
        ascending = np.argsort(suffix)
        entry, place = entry[ascending], place[ascending]
        order, common = interleave(shards, suffix[ascending], width)
        # repeated intervals: neighbours with `width` bytes in common
        joined = common >= width
        some = joined | np.append(joined[1:], False)
        order, interval = order[some], np.cumsum(~joined)[some]
        entry, place = entry[order], place[order] + c["lo"][entry[order]]
        docs = np.lexsort((c["row"], c["id"]))
        number = np.empty(len(docs), np.int64)
        number[docs] = np.cumsum(np.append(True, (c["row"][docs][1:] != c["row"][docs][:-1]) | (c["id"][docs][1:] != c["id"][docs][:-1])))
        key = number[entry] << 32 | place
        starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1])) if len(interval) else np.zeros(0, np.int64)
        earliest = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(key)))) if len(starts) else key
        later = np.unique(key[key > earliest])
        runs = np.flatnonzero(np.append(True, np.diff(later) != 1)) if len(later) else np.zeros(0, np.int64)
        row_of = np.zeros(len(docs) + 2, np.int64)
        row_of[number] = c["row"]
        return pa.table(
            [pa.array(row_of[later[runs] >> 32]), pa.array(later[runs] & 0xFFFFFFFF), pa.array(np.diff(np.append(runs, len(later))).astype(np.int32))], ["_row", "_lo", "_n"]
        )

    return merge


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each text that stay, and the runs that go."""
        for batch in batches:
            data, offsets = as_bytes(batch.column("_text"))
            for i, j in groups(offsets, GROUP):
                o = offsets[i : j + 1]
                part, o = data[o[0] : o[-1]], o - o[0]
                rows = batch.slice(i, j - i)
                marks = rows.column("_marks")
                start = o[pc.list_parent_indices(marks).to_numpy()] + (flat := pc.list_flatten(marks)).field("_lo").to_numpy()
                change = np.bincount(start, minlength=len(part) + 1) - np.bincount(start + flat.field("_n").to_numpy() - 1 + width, minlength=len(part) + 1)
                goes = np.cumsum(change)[: len(part)] > 0
                kept = np.concatenate([[0], np.cumsum(~goes)])[o]
                begins = goes.copy()
                begins[1:] &= ~goes[:-1]
                begins[o[:-1][o[:-1] < len(part)]] |= goes[o[:-1][o[:-1] < len(part)]]
                ends = goes.copy()
                ends[:-1] &= ~goes[1:]
                ends[o[1:][o[1:] > 0] - 1] |= goes[o[1:][o[1:] > 0] - 1]
                begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                bounds = np.searchsorted(begins, o).astype(np.int32)
                own = o[np.searchsorted(o, begins, "right") - 1]
                spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(begins - own), pa.array(ends - own)], ["start", "end"]))
                left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(part[~goes])])
                yield pa.RecordBatch.from_arrays([rows.column("_row"), rows.column("_id"), pa.array(np.diff(o)), spans, left.cast(pa.binary())], ["_row", "_id", "n_bytes", "spans", "kept"])
        rest()

    return cut


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """_row, _id, _text of docs in a table bucketed by _row, which later joins read without a shuffle; and the bytes of all texts."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    n, name = max(8, int(size // BUCKET)), f"clinflow_{uuid.uuid4().hex}"
    rows.repartition(n, "_row").write.bucketBy(n, "_row").option("path", new_path(spark)).format("parquet").saveAsTable(name)
    return spark.table(name), size


def repeated(table: DataFrame, size: int, width: int) -> DataFrame:
    """_row, _lo, _n: runs of strings of `width` bytes that also start earlier."""
    parts = max(8, int(size // PART))
    dealt = table.mapInArrow(_deal(width, parts), _DEALT)
    found = materialise(dealt.groupBy("part").applyInArrow(_settle, _FOUND))
    wanted = found.where("_pieces > 0")
    entries = wanted.agg(F.sum(F.col("_n") + width)).first()[0] or 0
    parts = max(8, int(entries // MERGE))
    asked = wanted.groupBy("_row").agg(F.collect_list(F.struct("_lo", "_n", "_at", "_pieces")).alias("_wanted"))
    transforms = table.join(asked, "_row").mapInArrow(_shards(width, parts), _SHARD)
    merged = transforms.groupBy("part").applyInArrow(_merge(width), "_row long, _lo long, _n int")
    return found.where("_pieces = 0").select("_row", "_lo", "_n").unionByName(materialise(merged))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, spans (array of start and end of the runs that go), kept (the bytes that stay)."""
    table, size = numbered(docs, id_col, text_col)
    marks = repeated(table, size, width).groupBy("_row").agg(F.collect_list(F.struct("_lo", "_n")).alias("_marks"))
    none = F.array().cast("array<struct<_lo:bigint,_n:int>>")
    whole = table.join(marks, "_row", "left").select("_row", "_id", "_text", F.coalesce("_marks", none).alias("_marks"))
    out = whole.mapInArrow(_cut(width), "_row long, _id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "spans", "kept")
