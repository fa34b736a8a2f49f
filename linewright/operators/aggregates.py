"""Grouped operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import line_test
from linewright.plans.ranking import group_rank
from linewright.plans.sizing import HOT_ROWS


def ordered_concat(
    df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], sep: str = ","
) -> DataFrame:
    """Values of a group joined in order: group, ``n_values``, ``text``, one row per group.

    The text of a group has to fit a cell, like any text; ``ordered_concat_parts`` is for
    groups beyond that.
    """
    rows = df.select(*dict.fromkeys(group), F.struct(*order, F.col(value).cast("string").alias("_v")).alias("_r"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["_v"]), sep)
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_values"), joined.alias("text"))


def ordered_concat_parts(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    order: Sequence[str],
    part_size: int,
    sep: str = ",",
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Values of a group joined in order, in parts of ``part_size`` values.

    Output: group, ``part`` from 0, ``n_values``, ``text``. The parts of a group, put
    together in order, are its whole text, and no task ever holds more than a part.
    """
    ranked = group_rank(df.select(*dict.fromkeys([*group, *order, value])), group, order, "_no", max_rows)
    cut = ranked.withColumn("part", F.expr(f"(_no - 1) div {int(part_size)}"))
    pairs = F.sort_array(F.collect_list(F.struct("_no", F.col(value).cast("string").alias("_v"))))
    return cut.groupBy(*group, "part").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.array_join(F.transform(pairs, lambda p: p["_v"]), sep).alias("text"),
    )


def exists_matching(
    df: DataFrame, group: Sequence[str], pattern: str, column: str = "text"
) -> DataFrame:
    """Per group: does any row match? Adds ``found``; combines before the shuffle."""
    test = line_test(pattern)
    return df.groupBy(*group).agg(F.bool_or(test(F.col(column))).alias("found"))


def any_matching(df: DataFrame, pattern: str, column: str = "text") -> bool:
    """Does any row match? Stops at the first hit."""
    return not df.filter(line_test(pattern)(F.col(column))).isEmpty()


def merge_last_wins(tables: Sequence[DataFrame], key: Sequence[str], value: str) -> DataFrame:
    """One row per key; the value of the last table that has the key wins.

    Within a table the largest value counts, so the result does not depend on row order. Rows
    are dealt by key first: keys hardly repeat inside a task, so combining there would only
    sort everything once more.
    """
    if not tables:
        raise ValueError("no tables")
    tagged = [t.select(*key, value, F.lit(i).alias("_no")) for i, t in enumerate(tables)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    rank = F.struct(F.col("_no"), F.col(value))
    return every.repartition(*key).groupBy(*key).agg(F.max_by(F.col(value), rank).alias(value))
