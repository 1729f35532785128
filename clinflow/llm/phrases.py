"""Collocations by growing phrases to the right, prefix by prefix.

Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs, A-Z lower-cased.
A first pass counts words. A second pass projects each task's texts: for every occurrence of a word that may be
frequent it keeps a pointer, which is the word and those after it up to the longest phrase or the piece's end;
equal pointers of a task are one with a count. Pointers are dealt by prefix, so that a prefix's whole projection
is in one place, sorted; there phrases grow depth first: a phrase's occurrences are one range of the sorted
pointers, its extensions are the runs inside the range, and only runs of enough occurrences are grown on.

Hot words: equal pointers are added up before they are dealt, and a prefix whose word has more than SPLIT of
a language's occurrences is dealt by its first two words, which are a prefix as well. Words that cannot be
frequent are told by a bitmap of fixed size (BITS) over hashes of frequent words; where it is full it only
prunes less. Every count is exact and over all texts, every product is a decimal of 38 digits.

Null text counts as empty, null language as `und`. Repeated rows count each. Words of any length are whole. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.llm.pieces import as_bytes, groups, rest
from clinflow.llm.runs import Words, inside
from clinflow.shared import materialise

#: Fixed values of the contract: what ends a piece, and what ends a word inside it.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
TABLE = inside(ENDS + SPACES)
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
#: Bytes of text handled at once; bits of the bitmap of frequent words; share of a language's words above which a first word is split.
GROUP, BITS, SPLIT = 2_500_000, 1 << 23, 0.002
#: Parts that pointers are dealt to: one for so many bytes of text.
PART = 10_000_000


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words, np.ndarray, np.ndarray]]:
    """Language, words, and which words are a piece's last, for groups of texts of one language."""
    for batch in batches:
        langs = pc.cast(batch.column("_lang"), pa.large_string())
        for lang in pc.unique(langs).to_pylist():
            data, offsets = as_bytes(batch.column("_text").filter(pc.equal(langs, lang)))
            for i, j in groups(offsets, GROUP):
                o = offsets[i : j + 1]
                part, o = data[o[0] : o[-1]], o - o[0]
                words = Words(part, o, TABLE)
                if not len(words.at):
                    continue
                ends = np.zeros(len(part) + 1, np.int32 if len(part) < 1 << 31 else np.int64)
                np.cumsum(_END[part], out=ends[1:])
                follows = np.append(words.at[1:], len(part))
                last = (ends[follows] != ends[words.ends]) | (np.append(words.text[1:], -1) != words.text)
                yield lang, words, words.codes, last


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, codes, _ in _grouped(batches):
        n = np.bincount(codes, minlength=len(words.known))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.known.cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
    rest()


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _cells(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spark's xxhash64(lang, word) of each word, and its bit in the bitmap."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)).astype(np.int64)
    return h, h % BITS


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """BITS bits, those of the hashes of frequent words set: made in executors in pieces of 4 KB, so what comes to the driver has a fixed size."""
    bit = F.pmod(_hash("lang", "word"), F.lit(BITS)) + 1  # Spark's buckets begin at value 1
    rows = frequent.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(BITS, bool)
    for r in rows.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        start = (r["b"] - 1) * len(bits)
        out[start : start + len(bits)] = bits[: BITS - start]
    return out


def _project(longest: int, frequent: np.ndarray, hot: dict[str, set[bytes]], parts: int):
    """The pointers of a group of texts, distinct with counts, in one row for each part: words, codes (0: no further word) and counts."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, last in _grouped(batches):
            known = words.known.to_pylist()
            h, cell = _cells(lang, known)
            some = frequent[cell]
            number = np.zeros(len(known), np.int64)
            number[some] = np.arange(1, int(some.sum()) + 1)
            n = number[codes]
            ahead = np.append(n[1:], 0) * ~last  # the next word of the piece, 0 where there is none that is frequent
            size = int(some.sum()) + 1
            table = np.zeros((longest, len(n)), np.int64)
            table[0] = n
            table[1] = ahead * (n > 0)
            for k in range(2, longest):
                table[k] = np.append(table[k - 1][1:], 0) * (table[1] > 0)
            table = table[:, table[1] > 0]
            if not table.shape[1]:
                continue
            runs, counts = _distinct(table, size)
            of_number = np.flatnonzero(some)
            split = np.isin(runs[0], number[[i for i in of_number if known[i] in hot.get(lang, ())]])
            part = h[of_number[runs[0] - 1]].astype(np.uint64)
            part = np.where(split, part * np.uint64(31) + h[of_number[runs[1] - 1]].astype(np.uint64), part) % np.uint64(parts)
            order = np.argsort(part.astype(np.int64), kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                mine = runs[:, order[bounds[p] : bounds[p + 1]]]
                used = np.unique(mine)
                used = used[used > 0]
                back = np.zeros(size, np.int32)
                back[used] = np.arange(1, len(used) + 1)
                blobs = [b"\n".join([known[i] for i in of_number[used - 1]]), back[mine].tobytes(), counts[order[bounds[p] : bounds[p + 1]]].astype(np.int32).tobytes()]  # no word has a line end
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([lang], pa.string()), *(pa.array([x], pa.binary()) for x in blobs)], ["part", "lang", "words", "codes", "counts"])
        rest()

    return project


def _distinct(table: np.ndarray, size: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of a table of numbers below size, in order, and how often each occurs."""
    if size ** len(table) < 1 << 62:
        key = table[0].astype(np.int64)
        for row in table[1:]:
            key = key * size + row
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(runs, len(key))) if counts is None else np.add.reduceat(counts, runs)
        key, out = key[runs], []
        for _ in table:
            key, row = np.divmod(key, size)
            out.append(row.astype(np.int32))
        return np.array(out[::-1]), n
    order = np.lexsort(table[::-1])
    table = table[:, order]
    runs = np.flatnonzero(np.append(True, (table[:, 1:] != table[:, :-1]).any(axis=0)))
    return table[:, runs], np.diff(np.append(runs, len(order))) if counts is None else np.add.reduceat(counts[order], runs)


def _grow(longest: int, least: int):
    """The phrases of one part's prefixes: lang, words, count."""

    def grow(rows: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for lang in pc.unique(rows["lang"]).to_pylist():
            mine = rows.filter(pc.equal(rows["lang"], lang))
            number: dict[bytes, int] = {}
            tables, counts = [], []
            for names, codes, count in zip(mine["words"], mine["codes"], mine["counts"], strict=True):
                back = np.array([0, *(number.setdefault(w, len(number) + 1) for w in names.as_py().split(b"\n"))], np.int32)
                tables.append(back[np.frombuffer(codes.as_buffer(), np.int32).reshape(longest, -1)])
                counts.append(np.frombuffer(count.as_buffer(), np.int32))
            tables, counts = np.concatenate(tables, axis=1), np.concatenate(counts).astype(np.int64)
            table, count = _distinct(tables, len(number) + 1, counts)
            del tables, counts
            words = pa.array(list(number), pa.binary()).cast(pa.string())
            for depth, at, n in _extensions(table, count, least):
                flat = words.take(pa.array((table[: depth + 1, at].T - 1).ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (depth + 1), pa.int32()), flat)
                out.append(pa.table({"lang": pa.array([lang] * len(at), pa.string()), "words": lists, "a": pa.array(n)}))
        empty = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64())]).empty_table()
        rest()
        return pa.concat_tables([empty, *out]).combine_chunks()

    return grow


def _extensions(table: np.ndarray, count: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(last word's place, where in the table, occurrences) of frequent phrases of two words and more, grown depth first. A stack holds ranges of the sorted pointers, each the projection of one phrase."""
    before = np.concatenate([[0], np.cumsum(count)])
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in table]
    new = [np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool) for row in table]
    stack = [(0, 0, table.shape[1])]
    while stack:
        depth, start, stop = stack.pop()
        if before[stop] - before[start] < least:
            continue
        cuts = np.flatnonzero(new[depth][start:stop]) + start
        if not len(cuts) or cuts[0] != start:
            cuts = np.append(start, cuts)
        ends = np.append(cuts[1:], stop)
        enough = (before[ends] - before[cuts] >= least) & (table[depth, cuts] > 0)
        cuts, ends = cuts[enough], ends[enough]
        if depth and len(cuts):
            found[depth].append((cuts, before[ends] - before[cuts]))
        if depth + 1 < len(table):
            stack += [(depth + 1, a, b) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return [(depth, np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])) for depth, got in enumerate(found) if got]


def _joined(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of 2 to `longest` words (lang, words, a), and all words (lang, word, n)."""
    docs = docs.select(F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))
    counted = docs.mapInArrow(_words, "lang string, word string, n long")
    words = materialise(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("_all"))
    hot: dict[str, set[bytes]] = {}  # at most 1 / SPLIT words of a language
    for r in frequent.join(totals, "lang").where(F.col("n") > SPLIT * F.col("_all")).select("lang", "word").toLocalIterator():
        hot.setdefault(r["lang"], set()).add(r["word"].encode())
    size = docs.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    parts = max(8, int(size // PART))
    pointers = docs.mapInArrow(_project(longest, _bitmap(frequent), hot, parts), "part int, lang string, words binary, codes binary, counts binary")
    found = pointers.groupBy("part").applyInArrow(_grow(longest, least), "lang string, words array<string>, a long")
    return materialise(found), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the highest collocations of each language.

    A phrase's score is that of its worst cut. A phrase inside a longer one with at least `covered` per cent of its occurrences is left out.
    """
    found, words = frequent_phrases(docs, text_col, lang_col, longest, least)
    whole = found.select("lang", _joined(F.col("words"), 1, F.size("words")).alias("phrase"), "a", F.size("words").alias("k"), "words")
    parts = whole.select("lang", F.col("phrase").alias("_part"), F.col("a").alias("_f")).unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("_part"), F.col("n").alias("_f")))
    cut = whole.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("_left"), _joined(F.col("words"), F.col("k") + 1, F.size("words")).alias("_right"))
    for side in ("left", "right"):
        cut = cut.join(parts.select("lang", F.col("_part").alias(f"_{side}"), F.col("_f").alias(side[0])), ["lang", f"_{side}"])
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    cut = cut.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).alias("_up"), (wide("l") * wide("r")).alias("_down"))
    cut = cut.withColumn("score", F.expr("_up div _down"))
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_w"))
    inner = [(k, s) for k in range(2, longest) for s in range(longest)]
    longer = whole.where(F.col("k") > 2).select("lang", F.col("a").alias("_longer"), "k", F.explode(F.array(*[F.when(F.col("k") >= F.lit(s + k + (s == 0)), _joined(F.col("words"), s + 1, k)) for k, s in inner])).alias("phrase")) if inner else None
    if longer is not None:
        hidden = longer.where("phrase is not null").groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
        worst = worst.join(hidden, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.select("lang", "phrase", "a", "_w.l", "_w.r", "_w.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
