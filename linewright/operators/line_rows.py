"""Line edits on tables with one row per line, for documents of any length.

Tables have the document keys ``doc``, ``pos`` (0, 1, .. without gaps in each document) and
``line``. ``line_edits`` does the same inside one row and is cheaper; here a single
document may be larger than a task can hold. Nothing gathers a document: marker
positions come from aggregations that combine before the shuffle, neighbours from joins
on (document, position), and windows run over chunks of positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.line_arrays import blank_repeat, literal_lines
from linewright.functions.text import line_test
from linewright.operators.line_edits import stale_line
from linewright.plans.scratch import written
from linewright.plans.sizing import all_equal, sized_join

# Positions per chunk. A window never sees more rows of a document than that.
CHUNK = 1_000_000


def _per_document(
    df: DataFrame, per_doc: DataFrame, doc: Sequence[str], write_first: bool = False
) -> DataFrame:
    """Add the columns of ``per_doc``, one row per document, NULL where it has none."""
    return sized_join(
        df, per_doc, {c: c for c in doc}, "left", null_safe=True, write_first=write_first
    )


def _block_rows(
    docs: DataFrame, doc: Sequence[str], block: Sequence[str], start: Column
) -> DataFrame:
    """The lines of ``block`` in each document, from position ``start`` on."""
    return docs.select(
        *doc, start.alias("_from"), F.posexplode(literal_lines(block)).alias("_i", "line")
    ).select(*doc, (F.col("_from") + F.col("_i")).cast("bigint").alias("pos"), "line")


def _rows(df: DataFrame, doc: Sequence[str], pos: Column | str = "pos") -> DataFrame:
    where = F.col(pos) if isinstance(pos, str) else pos
    return df.select(*doc, where.cast("bigint").alias("pos"), "line")


def _with_line(marks: DataFrame, df: DataFrame, doc: Sequence[str], at: str, name: str) -> DataFrame:
    """Add as ``name`` the line of ``df`` at position ``at``; only positions were aggregated."""
    there = {f"_d{i}": F.col(c) for i, c in enumerate(doc)} | {"_p": F.col("pos"), name: F.col("line")}
    found = df.select(*(c.alias(n) for n, c in there.items()))
    same = all_equal({c: f"_d{i}" for i, c in enumerate(doc)}, null_safe=True)
    joined = marks.join(found, same & (F.col(at) == F.col("_p")), "left")
    return joined.select(*marks.columns, name)


def _chunked(
    df: DataFrame, doc: Sequence[str], chunk: int, beyond: DataFrame | None = None
) -> DataFrame:
    """Add what a row knows of the rows before it in its document.

    ``_no`` is its number from 1 and ``_prev`` the line before; ``_chunk`` is kept, so that
    a second step on the same chunks finds its rows in place. Windows run over chunks of
    positions. Documents that stay within one chunk, usually all, are done with that.
    For the others, each chunk also gets the count and the last line of the chunks
    before it, from a table with one row per chunk. ``beyond`` has the keys of those documents,
    if the caller knows them.
    """
    part = df
    if "_chunk" not in df.columns:
        part = df.withColumn("_chunk", F.expr(f"pos div {int(chunk)}"))
    here = Window.partitionBy(*doc, "_chunk").orderBy("pos")
    seen = part.withColumns({"_no": F.row_number().over(here), "_prev": F.lag("line").over(here)})

    if beyond is None:
        beyond = written(df.filter(F.col("pos") >= chunk).select(*doc).distinct(), "long-docs")
    if beyond.isEmpty():
        return seen
    same = {c: c for c in doc}
    long_docs = sized_join(part, beyond, same, "left_semi", null_safe=True)
    chunks = long_docs.groupBy(*doc, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_end"))
    chunks = _with_line(chunks, long_docs, doc, "_end", "_last")
    order = Window.partitionBy(*doc).orderBy("_chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        *doc, "_chunk", F.sum("_n").over(earlier).alias("_before"), F.lag("_last").over(order).alias("_carry")
    ).filter("_before IS NOT NULL")
    known = sized_join(
        seen,
        carried,
        {**same, "_chunk": "_chunk"},
        "left",
        null_safe=True,
        write_first=True,
        hot_rows=None,
    )
    opening = (F.col("_no") == 1) & F.col("_before").isNotNull()
    return known.select(
        *part.columns,
        (F.col("_no") + F.coalesce(F.col("_before"), F.lit(0))).alias("_no"),
        F.when(opening, F.col("_carry")).otherwise(F.col("_prev")).alias("_prev"),
    )


def renumbered(
    df: DataFrame, doc: Sequence[str], chunk: int = CHUNK, beyond: DataFrame | None = None
) -> DataFrame:
    """Close the gaps in ``pos``."""
    return _rows(_chunked(df, doc, chunk, beyond), doc, F.col("_no") - 1)


def collapse_repeats(
    df: DataFrame,
    doc: Sequence[str],
    repeats: Callable[[Column, Column], Column] = blank_repeat,
    chunk: int = CHUNK,
) -> DataFrame:
    """Drop a line that repeats the line before it; ``pos`` keeps its gaps."""
    return _collapsed(df, doc, repeats, chunk).select(*df.columns)


def _collapsed(
    df: DataFrame,
    doc: Sequence[str],
    repeats: Callable[[Column, Column], Column],
    chunk: int,
    beyond: DataFrame | None = None,
) -> DataFrame:
    again = F.coalesce(repeats(F.col("_prev"), F.col("line")), F.lit(False))
    kept = _chunked(df, doc, chunk, beyond).filter((F.col("_no") == 1) | ~again)
    return kept.drop("_no", "_prev")


def grep_context(
    df: DataFrame,
    doc: Sequence[str],
    pattern: str,
    before: int = 2,
    after: int = 1,
    literal: bool = False,
    ignore_case: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Hit lines with the lines around them; adds ``is_hit``.

    Each hit adds only the positions that the hit before it in its chunk did not reach, so
    dense hits and wide surroundings do not multiply; repeats across chunks go by distinct.
    """
    test = line_test(pattern, literal, ignore_case)
    pos = F.col("pos")
    hits = df.filter(test(F.col("line"))).select(
        *doc, pos, F.expr(f"pos div {int(chunk)}").alias("_chunk")
    )
    here = Window.partitionBy(*doc, "_chunk").orderBy("pos")
    reached = F.coalesce(F.lag("pos").over(here) + F.lit(after + 1), F.lit(0))
    spans = hits.withColumn("_first", F.greatest(pos - F.lit(before), reached, F.lit(0)))
    last = pos + F.lit(after)
    fresh = F.when(F.col("_first") <= last, F.sequence(F.col("_first"), last))
    near = spans.select(*doc, F.explode(fresh).alias("pos")).distinct()
    found = sized_join(
        df,
        near,
        {c: c for c in [*doc, "pos"]},
        "left_semi",
        null_safe=True,
        write_first=True,
        hot_rows=None,
    )
    return found.withColumn("is_hit", test(F.col("line")))


def rewrite_first(
    df: DataFrame, doc: Sequence[str], find: str, repl: str, whole_line: bool = False
) -> DataFrame:
    """Replace ``find`` in the first line of each document that holds it."""
    test = line_test(find, literal=True)
    first = df.filter(test(F.col("line"))).groupBy(*doc).agg(F.min("pos").alias("_at"))
    new = F.lit(repl) if whole_line else F.replace(F.col("line"), F.lit(find), F.lit(repl))
    line = F.when(F.col("pos") == F.col("_at"), new).otherwise(F.col("line"))
    seen = _per_document(df, first, doc, write_first=True)
    return seen.withColumn("line", line).select(*df.columns)


def _with_empty(marks: DataFrame, docs: DataFrame | None, doc: Sequence[str]) -> DataFrame:
    """Add the documents of ``docs`` that have no line: their last position is -1."""
    if docs is None:
        return marks
    keys = docs.select(*(F.col(c).alias(f"_d{i}") for i, c in enumerate(doc)))
    keys = keys.groupBy(*keys.columns).agg(F.lit(-1).cast("bigint").alias("_none"))
    same = all_equal({c: f"_d{i}" for i, c in enumerate(doc)}, null_safe=True)
    both = marks.join(keys, same, "full_outer")
    named = [F.coalesce(c, f"_d{i}").alias(c) for i, c in enumerate(doc)]
    rest = [c for c in marks.columns if c not in (*doc, "_top")]
    return both.select(*named, *rest, F.coalesce("_top", "_none").alias("_top"))


def insert_before_marker(
    df: DataFrame,
    doc: Sequence[str],
    marker: str,
    block: Sequence[str],
    docs: DataFrame | None = None,
) -> DataFrame:
    """Insert ``block`` before the first marker line, or append marker and block.

    A document without lines has no rows here; ``docs``, a table with all document keys,
    lets it get marker and block as well.
    """
    test = line_test(marker, literal=True)
    marks = df.groupBy(*doc).agg(
        F.min(F.when(test(F.col("line")), F.col("pos"))).alias("_at"),
        F.max("pos").cast("bigint").alias("_top"),
    )
    docs = written(_with_empty(marks, docs, doc), "docs")
    after = F.col("pos") >= F.col("_at")
    moved = _per_document(df, docs, doc).select(
        *doc, F.when(after, F.col("pos") + len(block)).otherwise(F.col("pos")).alias("pos"), "line"
    )
    found, missing = docs.filter("_at IS NOT NULL"), docs.filter("_at IS NULL")
    return (
        _rows(moved, doc)
        .unionByName(_block_rows(found, doc, block, F.col("_at")))
        .unionByName(_block_rows(missing, doc, [marker, *block], F.col("_top") + 1))
    )


def cut_between_markers(
    df: DataFrame, doc: Sequence[str], start: str, end: str, block: Sequence[str] = ()
) -> DataFrame:
    """Replace what lies between two markers with ``block`` (see ``line_edits``)."""
    is_start, is_end = line_test(start, literal=True), line_test(end, literal=True)
    pos = F.col("pos")
    marks = df.select(
        *doc, pos, is_start(F.col("line")).alias("_opens"), is_end(F.col("line")).alias("_closes")
    ).filter("_opens OR _closes")
    # Three passes look at the marks: write them once instead of reading every line again.
    marks = written(marks, "marks")
    first = marks.filter("_opens").groupBy(*doc).agg(F.min("pos").alias("_first"))
    ends = (
        _per_document(marks.filter("_closes"), first, doc)
        .filter(pos > F.col("_first"))
        .groupBy(*doc)
        .agg(F.min("pos").alias("_end"))
    )
    gaps = (
        _per_document(marks.filter("_opens"), ends, doc)
        .filter(pos < F.col("_end"))
        .groupBy(*doc)
        .agg(F.max("pos").alias("_start"), F.max("_end").alias("_end"))
    )
    gaps = written(gaps, "gaps")
    lost = F.col("_end") - F.col("_start") - 1
    kept = _per_document(df, gaps, doc).filter(
        F.col("_end").isNull() | (pos <= F.col("_start")) | (pos >= F.col("_end"))
    )
    shifted = F.when(pos >= F.col("_end"), pos - lost + len(block)).otherwise(pos)
    return _rows(kept, doc, shifted).unionByName(
        _block_rows(gaps, doc, block, F.col("_start") + 1)
    )


def block_upsert(
    df: DataFrame,
    doc: Sequence[str],
    name: str,
    block: Sequence[str],
    broad: bool = False,
    chunk: int = CHUNK,
    docs: DataFrame | None = None,
) -> DataFrame:
    """Replace the block of ``name`` in every document, or append it (see ``line_edits``).

    A document without lines has no rows here; ``docs``, a table with all document keys,
    lets it get the block as well.
    """
    stale = stale_line(name, broad)
    fresh = ~stale(F.col("line"))
    # One row per document, also where every line goes. The last place that stays carries in its
    # lowest bit whether its line is blank: a maximum of numbers needs no sort.
    place = F.col("pos").cast("bigint") * 2 + (F.col("line") != "").cast("int")
    marks = df.groupBy(*doc).agg(
        F.max("pos").cast("bigint").alias("_top"), F.max(F.when(fresh, place)).alias("_end")
    )
    marks = written(_with_empty(marks, docs, doc), "docs")
    gap = marks.filter(F.coalesce(F.col("_end") % 2 == 1, F.lit(broad)))
    grown = reduce(
        DataFrame.unionByName,
        [
            _rows(df.filter(fresh), doc),
            _block_rows(gap, doc, ["", ""], F.col("_top") + 1),
            _block_rows(marks, doc, block, F.col("_top") + 3),
        ],
    )
    beyond = marks.filter(F.col("_top") + 3 + len(block) >= chunk).select(*doc)
    # Both steps use the same chunks, so numbering needs no further exchange.
    return renumbered(_collapsed(grown, doc, blank_repeat, chunk, beyond), doc, chunk, beyond)
