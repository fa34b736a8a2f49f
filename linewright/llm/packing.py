"""Documents into sequences of a fixed number of tokens: best-two-fit.

A sequence is filled greedily, each time with the longest piece that fits; then its smallest
piece gives way to two unpacked pieces that fill the wider gap more tightly, as long as there
are such two. Which sequence comes next only depends on how many pieces there are of each
length, so the plan is made from those counts, at most one per length, and a filling that
stays possible is repeated without being worked out again. Spark counts the pieces, ranks
them within their length, and joins each rank with the place the plan has for it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.arrow import mapped
from linewright.llm.bpe import PIECES, MergeList
from linewright.plans.scratch import written

SALTS = 64  # least number of parts in which the pieces of one length are ranked
PART = 200_000  # pieces in a part, about
LONG_RUN = 50_000  # blanks in a row from which a text is cut into pieces here


def _two(room: int, shortest: int, count: dict[int, int], mask: int) -> tuple[int, int] | None:
    """Two lengths that together are above ``shortest``, at most ``room``, and as long as can be."""
    best, two = shortest, None
    a = (mask & ((1 << room) - 1)).bit_length() - 1
    while a > 0 and 2 * a > best:
        b = (mask & ((1 << (min(a, room - a) + 1)) - 1)).bit_length() - 1
        if b == a and count[a] < 2:
            b = (mask & ((1 << a) - 1)).bit_length() - 1
        if b > 0 and a + b > best:
            best, two = a + b, (a, b)
            if best == room:
                break
        a = (mask & ((1 << a) - 1)).bit_length() - 1
    return two


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings, longest piece first, and how often each is used, in order."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= size for n in left):
        raise ValueError("a piece does not fit a sequence")
    out = []
    while left:
        now = dict(left)
        mask = sum(1 << n for n in now)  # lengths of which there are unpacked pieces
        used: Counter[int] = Counter()
        most: Counter[int] = Counter()  # of each length, in use at once

        def take(n: int) -> None:
            nonlocal mask
            now[n] -= 1
            mask ^= (now[n] == 0) << n
            used[n] += 1
            most[n] = max(most[n], used[n])

        gap = size
        while (n := (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            take(n)
            gap -= n
        while gap and used:
            shortest = min(used)
            two = _two(gap + shortest, shortest, now, mask)
            if two is None:
                break
            used[shortest] -= 1
            if not used[shortest]:
                del used[shortest]
            # Like any choice here, it rests on which lengths there are and on pairs of equals.
            for n in two:
                take(n)
            mask |= 1 << shortest
            now[shortest] += 1
            gap += shortest - sum(two)
        # The next sequence is filled alike while every choice finds what it found now.
        spare = 2  # a pair of equal lengths was possible or not
        times = min(max(1, (left[n] - most[n] - spare) // k + 1) for n, k in used.items())
        out.append((tuple(sorted(used.elements(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def places(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset), one per piece of a filling."""
    out, ranked, sequence = [], Counter(), 0
    for lengths, times in fillings:
        offset = 0
        for n in lengths:
            out.append((n, ranked[n], ranked[n] + times - 1, sequence, offset))
            ranked[n] += times
            offset += n
        sequence += times
    return out


@lru_cache(maxsize=1)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary file's ids are its merge ranks, which is what this encoder needs."""
    model = MergeList(path)
    ranks = {raw: i for i, raw in model.bytes_of.items()}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=model.special)


_BLANKS = regex.compile(rf"\s{{{LONG_RUN}}}")
_PIECES = regex.compile(PIECES)


def token_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a whole text; special strings count as such.

    The tokenizer's own search for pieces steps back through a run of blanks on a stack of bounded size.
    Texts with a long run are therefore cut here, by the same pattern, and only the ids of each
    piece come from it.
    """
    if len(text) < LONG_RUN or not _BLANKS.search(text):
        return encoding.encode(text, allowed_special="all")
    special = encoding._special_tokens
    names = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
    ids: list[int] = []
    for i, part in enumerate(regex.split(f"({names})", text) if names else [text]):
        if i % 2:
            ids.append(special[part])
        else:
            for piece in _PIECES.finditer(part):
                ids += encoding._encode_single_piece(piece[0])
    return ids


def pieces_of(docs: DataFrame, path: str, size: int) -> DataFrame:
    """Tokens of every text (special strings count as such), then id 0, cut when above ``size``.

    The first piece takes the odd tokens, so that the others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*token_ids(encoding, text.as_py() or ""), 0], dtype="<u4")
                end = (len(ids) - 1) % size + 1
                start, piece = 0, 0
                while start < len(ids):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + size, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return mapped(
        docs.select("doc_id", "text"), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Place of every piece of ``docs`` (doc_id, text, anything else) in sequences of ``size`` tokens.

    Returns per piece ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``
    and ``offset``; the pieces of a sequence lie side by side from 0. Which of several pieces of
    one length goes where follows the place at which each was written.

    A null text is empty and packs as the single id 0. Null ids, ids with several texts and repeated
    rows are packed like any. Other columns are ignored; an empty table gives no rows.
    """
    pieces = pieces_of(docs, path, size).withColumn("_at", F.monotonically_increasing_id())
    pieces = written(pieces, "op5-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(counts, size))
    # Bounded: a filling ends when a length runs out, so there are a few per length.
    spots = docs.sparkSession.createDataFrame(
        table, "length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint"
    )
    salts = max(SALTS, sum(counts.values()) // PART)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)))
    parts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("_at")
    ranked = salted.withColumn("_row", F.row_number().over(inside) - 1).join(parts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row"))
    spot = (ranked["length"] == spots["length"]) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    return ranked.join(F.broadcast(spots), spot).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        "offset",
    )
