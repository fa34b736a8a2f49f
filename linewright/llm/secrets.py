"""Secrets by pattern and by the cost of guessing them.

The base patterns find assignments, access keys and long hex strings. Beyond them, values
that stand where a credential would (after a naming word and a sign) are weighed: dynamic
programming finds the cheapest way to spell the value as common words, dates, repeats,
keyboard walks and characters guessed one by one. Only what no cheap spelling explains is a
secret; ``password: changeme`` is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.arrow import mapped
from linewright.plans.scratch import discard, written

KINDS = ("assign", "access", "hex", "guessed")

# Fixed by the contract of the base.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")

CUES = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "auth")
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|(?:client[ _-]?)?secret|(?:access[ _-]?)?token|credentials?
    |(?:api|access|private|secret)[ _-]?key|auth(?:orization)?|bearer)["']?
    (?:\x20{0,3}(?:=>|:=|[:=])\x20{0,3}|\x20is:?\x20)(?:bearer\x20|basic\x20)?["']?([^\s"'<>()\[\]{},;]{6,})""",
    re.I | re.A | re.X,
)
LEAST_COST = 8.0  # decimal digits of guesses from which a value is a secret
#: A word of the dictionary makes up one in so many of the uses of shared words, a use being a
#: text that has the word; so there are never more words than that.
WORDS = 100_000
#: Words that stand for a credential without being one (fixed values).
PLACEHOLDERS = "password passwd secret token changeme example default test admin user your key value null none true false".split()

ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_COLUMNS = tuple("".join(row[i] for row in ROWS if i < len(row)) for i in range(10))
_WALKS = {a + b for line in (*ROWS, *_COLUMNS) for a, b in zip(line, line[1:])}
_WALKS |= {w[::-1] for w in _WALKS}
_ORDERED = {chr(a) + chr(a + 1) for a in (*range(48, 57), *range(97, 122))}
_ORDERED |= {w[::-1] for w in _ORDERED}
_DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)"
)
_DAYS = math.log10(365 * 130)
LONGEST_WORD = 24


def runs_of(value: str) -> list[tuple[int, int, int]]:
    """Stretches (start, end, part) of at least two equal parts, as long as they go on.

    A part that is itself made of equal parts is left out: its stretch is one of the shorter part.
    Every length of part is compared over the whole value at once, in bytes times length / 2.
    """
    points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    found: list[tuple[int, int, int]] = []
    for part in range(1, len(points) // 2 + 1):
        same = points[part:] == points[:-part]
        if np.count_nonzero(same) < part:
            continue
        edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            end = stop + part
            if stop - start >= part and not any(
                part % shorter == 0 and first <= start and end <= last for first, last, shorter in found
            ):
                found.append((start, end, part))
    return found


class _Starts:
    """Places at which a stretch that grows by steps may have begun, and the cheapest of them.

    From place j to i it costs ``cost[j] + log10(scale * ((i - j) / step + more))``. That grows
    the slower the longer it is, so once an earlier place is the cheaper one it stays so, and the
    later place can be forgotten.
    """

    def __init__(self, scale: int, step: int, more: int):
        self.scale, self.step, self.more = scale, step, more
        self.places: list[int] = []

    def best(self, cost: list[float], i: int) -> float:
        cheapest, kept = math.inf, []
        for j in self.places:
            total = cost[j] + math.log10(self.scale * ((i - j) // self.step + self.more))
            if total < cheapest:
                cheapest = total
                kept.append(j)
        self.places = kept
        return cheapest


def _costs(value: str, ranks: dict[str, int], most: float) -> list[float]:
    """Cost of the cheapest spelling of every prefix; infinite from ``most``."""
    low, n = value.lower(), len(value)
    # A few letters grow by one in lower case; walks and words then see the value as it is.
    low = low if len(low) == n else value
    opening: dict[int, list[tuple[int, int, int]]] = {}
    for run in runs_of(value):
        opening.setdefault(run[0] + (2 if run[2] > 1 else 3) * run[2], []).append(run)
    open_runs: list[tuple[int, int, int, list[_Starts]]] = []
    cost = [0.0] * (n + 1)
    walk, walks = 0, _Starts(47 * 4, 1, 0)
    for i in range(1, n + 1):
        best = cost[i - 1] + 1.0
        for j in range(max(0, i - LONGEST_WORD), i - 2):
            rank = ranks.get(low[j:i])
            if rank is not None:
                capitals = sum(map(str.isupper, value[j:i]))
                best = min(best, cost[j] + math.log10(rank + 1) + min(capitals, i - j - capitals, 4) * 0.3 + (capitals > 0) * 0.3)
        if i > 1 and low[i - 2 : i] not in _WALKS and low[i - 2 : i] not in _ORDERED:
            walk, walks.places = i - 1, []
        if i - walk >= 3:
            walks.places.append(i - 3)
            best = min(best, walks.best(cost, i))
        for first, last, part in opening.pop(i, ()):
            open_runs.append((first, last, part, [_Starts(1, part, 1) for _ in range(part)]))
        open_runs = [run for run in open_runs if run[1] >= i]
        for _, _, part, starts in open_runs:
            of_place = starts[i % part]
            of_place.places.append(i - max(part, 2))
            best = min(best, of_place.best(cost, i))
        if low[i - 1].isdigit():
            for size in (4, 6, 7, 8, 9, 10):
                if i >= size and _DATE.fullmatch(value, i - size, i):
                    best = min(best, cost[i - size] + (math.log10(130) if size == 4 else _DAYS))
        cost[i] = best if best < most else math.inf
    return cost


def guess_cost(value: str, ranks: dict[str, int], most: float = math.inf) -> float:
    """log10 of the guesses that the cheapest spelling of ``value`` needs; infinite from ``most``.

    A character by itself costs a factor 10; a word its rank, twice for each way to write its
    capitals; a date the days of 130 years, a year alone 130; two or more equal parts (three or
    more equal characters) one part and their number; a walk of three or more keys or letters its
    start, direction and length. Each may begin and end anywhere, whatever its length.

    Costs only grow along a spelling, so a prefix of a long value settles it when no cheaper
    spelling reaches its second half: nothing that begins in the first half can pass the end
    without a stop in the second. What stays cheap all along is compared as a whole, in time
    that grows with the square of its length.
    """
    size = 4 * LONGEST_WORD
    while size < len(value):
        cost = _costs(value[:size], ranks, most)
        if all(map(math.isinf, cost[size // 2 :])):
            return math.inf
        size *= 2
    return _costs(value, ranks, most)[-1]


def spans_of(text: str, ranks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: the base, and values that are hard to guess."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if LONG_HEX.search(text):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    if any(cue in low for cue in CUES):
        taken = sorted((s, e) for _, s, e in found)
        at = 0
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            while end > start and text[end - 1] in ".!?:":
                end -= 1
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            free = at == len(taken) or taken[at][0] >= end
            if free and end - start >= 6 and guess_cost(text[start:end], ranks, LEAST_COST) >= LEAST_COST:
                found.append(("guessed", start, end))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def common_words(docs: DataFrame) -> dict[str, int]:
    """Rank of words by the number of texts that have them, from all whole texts.

    A word is shared if two different texts (by 64-bit hash) have it, so copies of a text that
    holds a secret make no word of it. Shared words with one in WORDS of all uses are ranked.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,24}"), F.lit(0))
    uses = docs.select(F.xxhash64("text").alias("of"), F.explode(F.array_distinct(found)).alias("word"))
    counts = uses.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("of").alias("first"), F.max("of").alias("last"))
    shared = written(counts.filter("first != last").select("word", "n"), "secrets-words")
    total = shared.agg(F.sum("n")).first()[0] or 0
    top = shared.filter(F.col("n") * WORDS >= total).collect()
    discard(shared)
    ranks = {word: i + 1 for i, word in enumerate(PLACEHOLDERS)}
    for row in sorted(top, key=lambda r: (-r["n"], r["word"])):
        ranks.setdefault(row["word"], len(ranks) + 1)
    return ranks


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of ``docs`` (doc_id, text, anything else).

    Returns ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (lowercase hex of the
    base's kind:start:end, joined by commas) and ``spans`` (all of them, the kind ``guessed`` too;
    places in code points, the end exclusive). A null text is empty. Null ids and repeated rows
    go through as they are. Other columns are ignored; an empty table gives no rows.
    """
    ranks = common_words(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = spans_of(text.as_py() or "", ranks)
                kinds = Counter(s[0] for s in spans)
                base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k != "guessed")
                every = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                digest = hashlib.sha256(base.encode()).hexdigest()
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], digest, every))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return mapped(
        docs.select("doc_id", "text"),
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )
