"""Edits of one document held as an array of lines.

Every function takes and returns Columns. The array stays inside its row, so none
of these edits needs a shuffle, a window or a sort. ``lines`` has to be a plain
column (not an expression): it is read from inside lambdas, and a plain column is
computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.text import LineTest


def literal_lines(block: Sequence[str]) -> Column:
    return F.array(*[F.lit(b) for b in block]).cast("array<string>")


def hit_flags(lines: Column, test: LineTest) -> Column:
    return F.transform(lines, test)


def first_hit(lines: Column, test: LineTest) -> Column:
    """1-based place of the first hit, 0 when there is none."""
    return F.array_position(hit_flags(lines, test), True)


def hit_places(lines: Column, test: LineTest) -> Column:
    """0-based places of all hits, ascending."""
    marked = F.transform(lines, lambda line, i: F.when(test(line), i))
    return F.filter(marked, lambda i: i.isNotNull())


def places_around(places: Column, size: Column, before: int, after: int) -> Column:
    """0-based places within reach of a hit, ascending and without repeats.

    Each hit adds only what the hit before it did not reach, so the work is that of the
    result, however dense the hits are. ``places`` has to be a plain column.
    """

    def fresh(p: Column, i: Column) -> Column:
        reached = F.when(i > 0, F.get(places, i - 1) + F.lit(after + 1)).otherwise(F.lit(0))
        first = F.greatest(p - F.lit(before), reached, F.lit(0))
        last = F.least(p + F.lit(after), size - 1)
        none = F.array().cast("array<int>")
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    return F.flatten(F.transform(places, fresh))


def without_repeats(lines: Column, repeats: Callable[[Column, Column], Column]) -> Column:
    """Drop a line when ``repeats(previous line, line)`` holds."""

    def keep(line: Column, i: Column) -> Column:
        again = F.coalesce(repeats(F.get(lines, i - 1), line), F.lit(False))
        return (i == 0) | ~again

    return F.filter(lines, keep)


def blank_repeat(previous: Column, line: Column) -> Column:
    return (previous == "") & (line == "")


def rewritten(
    lines: Column, test: LineTest, new: Callable[[Column], Column], only_at: Column | None
) -> Column:
    """Replace hit lines: all of them, or only the one at 1-based ``only_at``."""
    if only_at is None:
        return F.transform(lines, lambda line: F.when(test(line), new(line)).otherwise(line))
    # Asking for a hit first skips documents without one. It also reads ``only_at`` twice,
    # and Catalyst then keeps it a column of its own instead of moving the search for the
    # first hit into the lambda, where it would run once per line.
    changed = F.transform(
        lines, lambda line, i: F.when(i + 1 == only_at, new(line)).otherwise(line)
    )
    return F.when(only_at > 0, changed).otherwise(lines)


def with_block_at(lines: Column, at: Column, marker: str, block: Sequence[str]) -> Column:
    """Put ``block`` before 1-based ``at``; with ``at`` = 0 append marker and block."""
    added = literal_lines(block)
    inside = F.concat(
        F.slice(lines, F.lit(1), at.cast("int") - 1),
        added,
        F.slice(lines, at.cast("int"), F.size(lines)),
    )
    at_end = F.concat(lines, literal_lines([marker]), added)
    return F.when(at > 0, inside).otherwise(at_end)


def with_gap(lines: Column, last_kept: Column, first_kept: Column, block: Sequence[str]) -> Column:
    """Keep 1-based places up to ``last_kept`` and from ``first_kept`` on."""
    return F.concat(
        F.slice(lines, F.lit(1), last_kept.cast("int")),
        literal_lines(block),
        F.slice(lines, first_kept.cast("int"), F.size(lines)),
    )
