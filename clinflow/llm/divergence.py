"""How sources of a language differ in their terms: a sort-based audit.

Terms are runs of ASCII letters and characters outside ASCII, A-Z lower-cased. Each task sorts its terms by
(language, term, source, document); one scan along the runs gives the documents and the occurrences of a term
in a source, so a task passes on one partial row for each term and source it met. These rows are repartitioned
by (language, term) and sorted by source as well within the partition; a second scan along the runs adds them
up, keeps the terms of enough documents and writes one row for each kept term. A last scan over the kept terms
emits partial sums for each pair of sources and each source's highest terms, which are added up and ranked.

A hot term, language or source costs no task more than its share: a term has at most one row for each task and
source after the first scan, and the last scan reads kept terms in any split. The pairs of a language's sources
are the result itself; the table of the sources with their sums goes to all tasks and is as long as one side
of these pairs. All arithmetic is on whole numbers.

Null text, language and source count as empty strings. A document without terms still makes its source occur.
Repeated rows are documents of their own. Terms of any length are whole. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinflow.llm.pieces import as_bytes, groups, rest
from clinflow.llm.runs import Words, inside
from clinflow.shared import materialise

#: Bytes outside terms: all of ASCII but its letters.
TABLE = inside(bytes(b for b in range(128) if not chr(b).isalpha()))
#: Texts of about so many bytes are sorted at once, and so many cells of a term-by-source matrix are scanned at once.
GROUP, CELLS = 16_000_000, 1_000_000
UNIT = 1_000_000_000


def _changes(*columns: np.ndarray) -> np.ndarray:
    """First positions of the runs in which all columns stay the same."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, source, docs, count: one row for each term and source of a group of texts."""
    for batch in batches:
        data, offsets = as_bytes(batch.column("_text"))
        langs, sources = (pc.cast(batch.column(c), pa.large_string()).dictionary_encode() for c in ("_lang", "_source"))
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
        for i, j in groups(offsets, GROUP):
            o = offsets[i : j + 1]
            words = Words(data[o[0] : o[-1]], o - o[0], TABLE)
            if not len(words.at):
                continue
            doc = words.text
            n_term, n_source = len(words.known), len(sources.dictionary)
            key = (lang[i + doc] * n_term + words.codes) * n_source + source[i + doc]
            if n_term * n_source * len(langs.dictionary) * (j - i) < 1 << 62:  # one number holds the whole order
                both = np.sort(key * (j - i) + doc)
                key, doc = np.divmod(both, j - i)
            else:
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
            per_doc = _changes(key, doc)
            runs = _changes(key)
            docs = np.diff(np.append(np.searchsorted(per_doc, runs), len(per_doc)))
            count = np.diff(np.append(runs, len(key)))
            rest_key, s = np.divmod(key[runs], n_source)
            g, t = np.divmod(rest_key, n_term)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(g)), words.known.cast(pa.large_string()).take(pa.array(t)), sources.dictionary.take(pa.array(s)), pa.array(docs), pa.array(count)],
                ["_lang", "_term", "_source", "_docs", "_count"],
            )
    rest()


def _kept(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run of (lang, term) of at least `least` documents: its sources and the occurrences in each. The last run of a batch waits for the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks() if held else pa.Table.from_batches([batch])
            cut = len(rows) - _tail(rows)
            held = rows.slice(cut).to_batches()
            yield from _settle(rows.slice(0, cut), least)
        if held:
            yield from _settle(pa.Table.from_batches(held), least)

    return scan


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int32)


def _tail(rows: pa.Table) -> int:
    """Rows of the last run."""
    if not len(rows):
        return 0
    same = pc.and_(pc.equal(rows["_lang"], rows["_lang"][-1]), pc.equal(rows["_term"], rows["_term"][-1]))
    return len(rows) - int(pc.index(same, True).as_py())


def _settle(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    term, source = (_codes(rows[c]) for c in ("_term", "_source"))
    lang = _codes(rows["_lang"])
    runs = _changes(lang, term)
    docs, count = (rows[c].to_numpy() for c in ("_docs", "_count"))
    keep = np.add.reduceat(docs, runs) >= least
    parts = _changes(lang, term, source)
    per_source = np.add.reduceat(count, parts)
    of = np.searchsorted(runs, parts, "right") - 1
    kept = keep[of]
    sizes = np.bincount(of, minlength=len(runs))[keep]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    take = lambda c, at: rows[c].combine_chunks().take(pa.array(at))
    yield pa.RecordBatch.from_arrays(
        [take("_lang", runs[keep]), take("_term", runs[keep]), pa.ListArray.from_arrays(ends, take("_source", parts[kept])), pa.ListArray.from_arrays(ends, pa.array(per_source[kept]))],
        ["_lang", "_term", "_sources", "_counts"],
    )


def _share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    return 1 + UNIT * (count + 1) // (total + terms)


def _beyond(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Both are at most UNIT + 1, so the square fits 64 bits."""
    d = p - q
    return d * d // q


def _scan(tables: dict[str, tuple[list[str], list[int], int, int]], ranks: int):
    """tables: for each language its sources, their sums, its own sum and its number of terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[str, list] = {}
        for batch in batches:
            langs = batch.column("_lang")
            for lang in pc.unique(langs).to_pylist():
                rows = batch.filter(pc.equal(langs, lang))
                sources, sums, total, terms = tables[lang]
                if lang not in pairs:
                    pairs[lang] = np.zeros((len(sources), len(sources)), np.int64)
                    best[lang] = [(np.zeros(0, np.int64), []) for _ in sources]
                n = np.array(sums, np.int64)
                step = max(1, CELLS // len(sources))
                for i in range(0, len(rows), step):
                    part = rows.slice(i, step)
                    lists = part.column("_sources")
                    row = pc.list_parent_indices(lists).to_numpy()
                    col = pc.index_in(pc.list_flatten(lists), pa.array(sources, lists.type.value_type)).to_numpy(zero_copy_only=False)
                    count = np.zeros((len(part), len(sources)), np.int64)
                    count[row, col] = pc.list_flatten(part.column("_counts")).to_numpy()
                    p = _share(count, n, terms)
                    for a in range(len(sources)):
                        pairs[lang][a] += _beyond(p[:, a : a + 1], p).sum(axis=0)
                    q = _share(count.sum(axis=1), total, terms)
                    names = part.column("_term")
                    for a in range(len(sources)):
                        at = np.flatnonzero((count[:, a] > 0) & (p[:, a] > q))
                        best[lang][a] = _highest(best[lang][a], _beyond(p[at, a], q[at]), names, at, ranks)
        for lang, found in pairs.items():
            sources = tables[lang][0]
            a, b = np.nonzero(found)
            yield _rows(lang, [sources[x] for x in a], "pair", [sources[x] for x in b], found[a, b])
            for s, (value, names) in zip(sources, best[lang], strict=True):
                yield _rows(lang, [s] * len(names), "term", names, value)

    return scan


def _highest(before: tuple[np.ndarray, list[str]], value: np.ndarray, names: pa.Array, at: np.ndarray, ranks: int) -> tuple[np.ndarray, list[str]]:
    """The highest values of both, ties by name. Only rows that may get a rank are looked at by name."""
    old, old_names = before
    if len(value) > ranks:
        floor = np.partition(value, len(value) - ranks)[len(value) - ranks]
        at, value = at[value >= floor], value[value >= floor]
    if len(old) == ranks:
        at, value = at[value >= old[-1]], value[value >= old[-1]]
    if not len(at):
        return before
    all_names = old_names + names.take(pa.array(at)).to_pylist()
    values = np.concatenate([old, value])
    order = sorted(range(len(values)), key=lambda i: (-values[i], all_names[i].encode()))[:ranks]
    return values[order], [all_names[i] for i in order]


def _rows(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    same = lambda x: pa.array([x] * len(item), pa.string())
    return pa.RecordBatch.from_arrays([same(lang), pa.array(source, pa.string()), same(part), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. part 'pair': item is another source of the language; 'term': a kept term above the language's share."""
    spark = docs.sparkSession
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(empty(text_col, "_text"), empty(lang_col, "_lang"), empty(source_col, "_source"))
    partial = docs.mapInArrow(_partial, "_lang string, _term string, _source string, _docs long, _count long")
    runs = partial.repartition("_lang", "_term").sortWithinPartitions("_lang", "_term", "_source")
    kept = materialise(runs.mapInArrow(_kept(least), "_lang string, _term string, _sources array<string>, _counts array<long>"))
    occurring = docs.groupBy("_lang", "_source").agg(F.lit(1).alias("_one"))
    sums = kept.select("_lang", F.explode(F.arrays_zip("_sources", "_counts")).alias("x")).groupBy("_lang", F.col("x._sources").alias("_source")).agg(F.sum("x._counts").alias("_n"))
    terms = kept.groupBy("_lang").agg(F.count("*").alias("_v"))
    grouped = materialise(occurring.join(sums, ["_lang", "_source"], "left").join(terms, "_lang", "left").select("_lang", "_source", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_v", F.lit(0)).alias("_v")))
    tables: dict[str, tuple[list[str], list[int], int, int]] = {}
    for r in grouped.orderBy("_lang", "_source").toLocalIterator():
        sources, n, total, _ = tables.get(r["_lang"], ([], [], 0, 0))
        tables[r["_lang"]] = ([*sources, r["_source"]], [*n, r["_n"]], total + r["_n"], r["_v"])
    found = materialise(kept.mapInArrow(_scan(tables, ranks), "lang string, source string, part string, item string, value long"))
    left, right = (grouped.select(F.col("_lang").alias("lang"), F.col("_source").alias(c)) for c in ("source", "item"))
    added = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = left.join(right, "lang").where("source <> item").join(added, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return ranked.unionByName(top)
