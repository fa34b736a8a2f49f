"""Edits of packed documents (``lines array<string>``, see ``sources.lines``).

Order inside a document is the order of its array, so every edit is a projection of
the row: no shuffle, no sort, no window, and a frequent key cannot make a hot task.
The row bounds the work of one step, as it already bounds the document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import line_arrays as la
from linewright.functions.text import LineTest, line_test, quoted
from linewright.sources.lines import unpacked


def collapse_repeats(
    df: DataFrame, repeats: Callable[[Column, Column], Column] = la.blank_repeat
) -> DataFrame:
    """Drop a line that repeats the line before it; by default blank after blank."""
    return df.withColumn("lines", la.without_repeats(F.col("lines"), repeats))


def grep_context(
    df: DataFrame,
    pattern: str,
    before: int = 2,
    after: int = 1,
    literal: bool = False,
    ignore_case: bool = False,
) -> DataFrame:
    """Hit lines with the lines around them: other columns, ``pos``, ``line``, ``is_hit``.

    Lines are only copied out near hits. Overlapping surroundings give each line once.
    For a literal, ``packed(.., holding=literal)`` skips other texts before the split.
    """
    test = line_test(pattern, literal, ignore_case)
    others = [c for c in df.columns if c != "lines"]
    hits = df.withColumn("_hits", la.hit_places(F.col("lines"), test))
    near = F.transform(
        la.places_around(F.col("_hits"), F.size("lines"), before, after), lambda p: F.struct(p.alias("pos"), F.get(F.col("lines"), p).alias("line"))
    )
    # Outer, as in ``unpacked``: no inferred filter that would do the search twice.
    rows = hits.select(*others, F.explode_outer(near).alias("_row")).filter("_row IS NOT NULL")
    return rows.select(*others, "_row.pos", "_row.line").withColumn("is_hit", test(F.col("line")))


def rewrite_lines(
    df: DataFrame, find: str, repl: str, mode: str = "first", whole_line: bool = False
) -> DataFrame:
    """Replace ``find`` in the first line that holds it, or in ``all`` such lines.

    ``whole_line`` puts ``repl`` in place of the full line.
    """
    if mode not in ("first", "all"):
        raise ValueError(f"mode {mode!r}: use 'first' or 'all'")
    test = line_test(find, literal=True)

    def new(line: Column) -> Column:
        return F.lit(repl) if whole_line else F.replace(line, F.lit(find), F.lit(repl))

    if mode == "all":
        return df.withColumn("lines", la.rewritten(F.col("lines"), test, new, None))
    return (
        df.withColumn("_at", la.first_hit(F.col("lines"), test))
        .withColumn("lines", la.rewritten(F.col("lines"), test, new, F.col("_at")))
        .drop("_at")
    )


def rewrite_by_rules(
    df: DataFrame, rules: Sequence[tuple[str, str]], whole_line: bool = True
) -> DataFrame:
    """Apply several (find, new) rules in one pass over the lines.

    Each line takes the rules in order and sees what the ones before made of it. By default
    ``new`` replaces the whole line that holds ``find``.
    """

    def rewritten(line: Column) -> Column:
        for find, new in rules:
            changed = F.lit(new) if whole_line else F.replace(line, F.lit(find), F.lit(new))
            line = F.when(line_test(find, literal=True)(line), changed).otherwise(line)
        return line

    return df.withColumn("lines", F.transform("lines", rewritten)) if rules else df


def insert_before_marker(df: DataFrame, marker: str, block: Sequence[str]) -> DataFrame:
    """Insert ``block`` before the first line holding ``marker``.

    Without such a line, ``marker`` and ``block`` go to the end.
    """
    test = line_test(marker, literal=True)
    return (
        df.withColumn("_at", la.first_hit(F.col("lines"), test))
        .withColumn("lines", la.with_block_at(F.col("lines"), F.col("_at"), marker, block))
        .drop("_at")
    )


def cut_between_markers(
    df: DataFrame, start: str, end: str, block: Sequence[str] = ()
) -> DataFrame:
    """Replace what lies between two markers with ``block``; marker lines stay.

    The cut ends at the first end line after any start line, and begins at the last
    start line before that. A document without such a pair is left as it is.
    """
    lines = F.col("lines")
    is_start, is_end = line_test(start, literal=True), line_test(end, literal=True)
    flags = df.withColumns(
        {"_starts": la.hit_flags(lines, is_start), "_ends": la.hit_flags(lines, is_end)}
    )
    first = flags.withColumn("_first", F.array_position("_starts", True).cast("int"))
    last = first.withColumn(
        "_end",
        F.array_position(F.slice("_ends", F.col("_first") + 1, F.size("_ends")), True).cast("int"),
    )
    # Seen backwards from the end line, the nearest start line is the last one before it.
    back = F.array_position(
        F.reverse(F.slice("_starts", F.lit(1), F.greatest(F.col("_first") + F.col("_end") - 1, F.lit(0)))), True
    ).cast("int")
    kept = F.col("_first") + F.col("_end") - back
    edited = la.with_gap(lines, kept, F.col("_first") + F.col("_end"), block)
    found = (F.col("_first") > 0) & (F.col("_end") > 0)
    return last.withColumn("lines", F.when(found, edited).otherwise(lines)).select(*df.columns)


def env_block(name: str, home: str, *relative: str) -> list[str]:
    """The lines that define an environment variable and extend the search path.

    The name is put in upper case, like that of the block which ``block_upsert`` removes.
    """
    name = name.upper()
    return [
        f"# {name}",
        f"export {name}={home}",
        *[f"export PATH=$PATH:${name}/{r}" for r in ("bin", *relative)],
    ]


def stale_line(name: str, broad: bool = False) -> LineTest:
    """Test for the lines of the block of ``name`` (see ``block_upsert``)."""
    if name[:1].isdigit():
        raise ValueError(f"a name cannot start with a digit: {name}")
    if broad:
        return line_test(name, literal=True)
    name = name.upper()
    tests = [
        line_test(rf"^#\s+\b{quoted(name)}\b"),
        line_test(f"export {name}=", literal=True),
        line_test(f"${name}", literal=True),
    ]
    return lambda line: tests[0](line) | tests[1](line) | tests[2](line)


def block_upsert(
    df: DataFrame, name: str, block: Sequence[str], broad: bool = False
) -> DataFrame:
    """Replace the block of ``name`` in every document, or append it.

    Lines of the old block go: ``# NAME`` (a blank after ``#`` is needed), those holding
    ``export NAME=``, and those holding ``$NAME`` (also as the head of a longer name).
    ``broad`` drops every line that holds the name, as given. Then a blank line, the block, and
    runs of blanks collapsed. The broad form always writes the blank line first, so a
    document left without lines begins with one; the other form then begins with the block.
    """
    stale = stale_line(name, broad)
    kept = df.withColumn("lines", F.filter("lines", lambda line: ~stale(line)))
    last = F.get(F.col("lines"), F.size("lines") - 1)
    needs_gap = F.coalesce(last != "", F.lit(broad))
    gap = F.when(needs_gap, la.literal_lines(["", ""])).otherwise(la.literal_lines([]))
    grown = kept.withColumn("lines", F.concat(F.col("lines"), gap, la.literal_lines(block)))
    return collapse_repeats(grown)


def head_lines(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines of each document, as rows with their ``pos``."""
    return unpacked(df.withColumn("lines", F.slice("lines", F.lit(1), F.lit(n))))


def tail_lines(df: DataFrame, n: int) -> DataFrame:
    """Last ``n`` lines of each document, as rows with their ``pos``."""
    skip = F.greatest(F.size("lines") - F.lit(n), F.lit(0))
    others = [c for c in df.columns if c != "lines"]
    cut = df.select(
        *others, skip.alias("_skip"), F.slice("lines", skip + 1, F.lit(n)).alias("lines")
    )
    rows = unpacked(cut)
    return rows.select(*others, (F.col("pos") + F.col("_skip")).alias("pos"), "line")
