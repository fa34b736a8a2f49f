"""Sorting, heads and tails, and the one sorted grep chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.text import line_test
from linewright.operators.filters import grep_lines
from linewright.plans.ranking import early_cut, global_rank, group_rank
from linewright.plans.sizing import sized_join


def _orderable(df: DataFrame) -> list[str]:
    """Columns that rows can be sorted by."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def sort_lines(
    df: DataFrame, line: str = "line", ties: Sequence[str] = (), rank: str | None = None
) -> DataFrame:
    """Lines in code point order, a range exchange. ``rank`` adds the 1-based place.

    Equal lines are ordered by ``ties`` and then by the other columns, which also lets a
    very frequent line spread over tasks.
    """
    by = list(dict.fromkeys([line, *ties, *df.columns]))
    return df.orderBy(*by) if rank is None else global_rank(df, by, rank)


def tagged_grep(
    df: DataFrame,
    exclude: str,
    include: str,
    line: str = "line",
    ties: Sequence[str] = (),
    rank: str | None = None,
) -> DataFrame:
    """Drop lines holding ``exclude``, keep those matching ``include`` in any case, sort.

    Both filters run before the sort, which gives the same rows for less work.
    """
    kept = grep_lines(
        grep_lines(df, exclude, literal=True, invert=True, line=line),
        include,
        ignore_case=True,
        line=line,
    )
    return sort_lines(kept, line, ties, rank)


def head_tail(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, end: str = "head"
) -> DataFrame:
    """First or last ``n`` rows of each group, with ``rank`` counted from that end.

    Rows that are equal in ``order`` follow their other columns, so the answer does not depend
    on chance. Without a group it is a top-n of the whole table: its rows are cut to n in each
    task first, or, for a large n, ranked in runs over many tasks.
    """
    order = list(dict.fromkeys([*order, *_orderable(df)]))
    keys: list[Column] = [F.col(c).asc() if end == "head" else F.col(c).desc() for c in order]
    if not group:
        if n <= early_cut(df):
            top = df.orderBy(*keys).limit(n)
            return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
        ranked = global_rank(df, order, "rank")
        if end == "tail":
            ranked = ranked.withColumn("rank", F.lit(df.count()) - F.col("rank") + 1)
        return ranked.filter(F.col("rank") <= n)
    if n <= early_cut(df):
        window = Window.partitionBy(*group).orderBy(*keys)
        ranked = df.withColumn("rank", F.row_number().over(window).cast("int"))
        return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))
    ranked = group_rank(df, group, order, "rank")
    if end == "head":
        return ranked.filter(F.col("rank") <= n)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    sized = sized_join(ranked, sizes, {g: g for g in group}, "inner", null_safe=True)
    back = F.col("_size") - F.col("rank") + 1
    return sized.withColumn("rank", back).filter(F.col("rank") <= n).select(*df.columns, "rank")


def kth_match(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    pattern: str,
    k: int,
    line: str = "line",
    literal: bool = False,
) -> DataFrame:
    """Row number ``k`` (from 0) among the matching rows of each group.

    Groups with fewer matches give nothing. Ties in ``order`` follow the other columns.
    """
    hits = df.filter(line_test(pattern, literal)(F.col(line)))
    order = list(dict.fromkeys([*order, *_orderable(df)]))
    if k < early_cut(df):
        window = Window.partitionBy(*group).orderBy(*order)
        ranked = hits.withColumn("_rank", F.row_number().over(window))
    else:
        ranked = group_rank(hits, group, order, "_rank")
    return ranked.filter(F.col("_rank") == k + 1).drop("_rank")
