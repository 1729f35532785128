"""Secrets in texts: fixed patterns, and character Markov models for what the patterns miss.

Two order-2 character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A run of identifier characters is a secret when the log-likelihood ratio per
character exceeds a threshold; runs that a fixed pattern covers keep the pattern's span. Offsets are
code points, ends exclusive. Null texts count as empty; every row is judged for itself, so repeated
rows repeat their result; other columns are dropped by `scan` but for the id. Spans of one start are
ordered by kind. Very long texts are read whole, in time that grows with their length. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, expression, group whose length counts, least length. Offsets are of the whole match.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of these characters that is shorter than 32 is dropped, so runs of 32 and more are all that is looked for.
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that the models judge: identifier characters, no shorter than this, with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WORDS = ["key", "token", "password", "passwd", "secret"]
#: Parts from which ordinary identifiers are made.
PARTS = (
    "get set is has new old max min user name value index count total order item list map data file path line text page row col key id type node "
    "link time date start end first last next prev open close read write send load save build parse print format check test main util base core "
    "http server client request response error result status config option default public static final class function return string number array"
).split()


def samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled samples: (run, 1) drawn evenly from hexadecimal, base-62 and base-64 alphabets, (run, 0) joined from PARTS."""
    draw = random.Random(seed)
    kinds = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62]]
    out = [("".join(draw.choices(kinds[i % 4], k=draw.randint(16, 48))), 1) for i in range(n)]
    for i in range(n):
        parts = draw.choices(PARTS, k=draw.randint(3, 6))
        joined = ["_".join, "-".join, "".join, "/".join, lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: "_".join(p).upper()][i % 6](parts)
        out.append((joined + (str(draw.randint(0, 2030)) if i % 3 == 0 else ""), 0))
    return out


class MarkovPair:
    """Log-likelihood ratio of order-2 character models with back-off to order 1 by fixed shares."""

    def __init__(self, labelled: list[tuple[str, int]], share: float = 0.7):
        self.table: list[dict[str, float]] = []
        for label in (0, 1):
            two: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
            one: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
            for run, kind in labelled:
                if kind == label:
                    run = "\0\0" + run
                    for a, b, c in zip(run, run[1:], run[2:], strict=False):
                        two[a + b][c] += 1
                        one[b][c] += 1
            v = len(ALPHABET)
            table: dict[str, float] = {}
            for b in [*ALPHABET, "\0"]:
                low = {c: (one[b][c] + 0.5) / (sum(one[b].values()) + 0.5 * v) for c in ALPHABET}
                for a in [*ALPHABET, "\0"]:
                    if b == "\0" and a != "\0":
                        continue
                    seen = two.get(a + b, {})
                    n = sum(seen.values())
                    for c in ALPHABET:
                        table[a + b + c] = math.log(share * (seen.get(c, 0) + low[c]) / (n + 1) + (1 - share) * low[c])
            self.table.append(table)
        self.ratio = {k: p - self.table[0][k] for k, p in self.table[1].items()}
        self.table.clear()

    def score(self, run: str) -> float:
        """Log-likelihood ratio per character; above 0 the random model fits better."""
        at = "\0\0" + run
        return sum(self.ratio.get(at[i : i + 3], 0.0) for i in range(len(run))) / max(1, len(run))


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    lower = text.lower() if lower is None else lower
    out = []
    if any(w in lower for w in WORDS) or "api" in lower:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def random_spans(text: str, base: list[tuple[int, str, int]], models: MarkovPair, threshold: float) -> list[tuple[int, str, int]]:
    """Runs that the models call random and that touch no span of base."""
    out, far, at = [], 0, 0  # far: the furthest end of the base spans, sorted by their starts, that begin before the run's end
    for m in CANDIDATE.finditer(text):
        run = m[0]
        while at < len(base) and base[at][0] < m.end():
            far = max(far, base[at][2])
            at += 1
        if far <= m.start() and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and models.score(run) > threshold:
            out.append((m.start(), "random", m.end()))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """One row per document: id_col, found array<struct<kind, start_at, end_at, secret>> by start, then kind.

    threshold: log-likelihood ratio a character above which a run is a secret. labelled: (run, 1 for random) pairs to train from.
    """
    models = MarkovPair(samples() if labelled is None else labelled)

    id_type = docs.schema[id_col].dataType
    span = pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("secret", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base, models, threshold), key=lambda s: (s[0], KINDS.index(s[1])))
                found.append([{"kind": k, "start_at": s, "end_at": e, "secret": text[s:e]} for s, k, e in spans])
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(span))], names=[id_col, "found"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(find, f"`{id_col}` {id_type.simpleString()}, found array<struct<kind:string,start_at:long,end_at:long,secret:string>>")


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans give one replacement."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
