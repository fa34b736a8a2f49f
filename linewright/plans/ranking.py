"""Row numbers without a single-task window.

Spark's range exchange cuts a sorted order into even runs. A run is written once with
its row ids; a rank is then the id inside the run plus the rows of all runs before.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.plans.scratch import written
from linewright.plans.sizing import HOT_ROWS, all_equal, fits_broadcast, split_hot

# Up to so many rows per group Spark cuts each task's share of a ``row_number() <= n`` before
# the shuffle, so that a hot group is small by then.
CUT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def early_cut(df: DataFrame) -> int:
    """The session's bound for that cut; -1 when it is off."""
    return int(df.sparkSession.conf.get(CUT_CONF, "1000"))


# monotonically_increasing_id keeps the partition above bit 33 and the row below it.
_ROW_BITS = 33


def sorted_runs(
    df: DataFrame, by: Sequence[str], label: str, n_runs: int | None = None
) -> DataFrame:
    """Rows in even sorted runs, with ``_run`` and ``_row`` (0-based in the run).

    A last, random part of the range key lets rows that are equal in ``by`` spread over runs, so
    no value, however frequent, fills one. ``n_runs`` defaults to the shuffle partitions of
    the session.
    """
    salted = df.withColumn("_salt", F.rand(20))
    wide = [*by, "_salt"]
    spread = salted.repartitionByRange(n_runs, *wide) if n_runs else salted.repartitionByRange(*wide)
    runs = spread.sortWithinPartitions(*wide).drop("_salt")
    table = written(runs.withColumn("_id", F.monotonically_increasing_id()), label)
    return table.select(
        *df.columns,
        F.shiftright("_id", _ROW_BITS).alias("_run"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def global_rank(df: DataFrame, by: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank of every row in the order of ``by``.

    One row per run reaches the driver, so that list is as long as the exchange has
    partitions, whatever the number of rows.
    """
    runs = sorted_runs(df, by, "rank")
    sizes = sorted(
        (r["_run"], r["n"]) for r in runs.groupBy("_run").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(run, start) for (run, _), start in zip(sizes, before)], "_run bigint, _before bigint"
    )
    return runs.join(F.broadcast(offsets), "_run").select(
        *df.columns, (F.col("_before") + F.col("_row") + 1).alias(name)
    )


def group_rank(
    df: DataFrame,
    group: Sequence[str],
    by: Sequence[str],
    name: str = "rank",
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based rank of every row in its group, in the order of ``by``.

    Ordinary groups take a window. Groups above ``max_rows`` rows are cut into sorted
    runs over many tasks.
    """
    window = Window.partitionBy(*group).orderBy(*by)
    cold, hot, n_runs = split_hot(df, group, max_rows)
    ranked = cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    if hot is None:
        return ranked

    runs = sorted_runs(hot, [*group, *by], "group-rank", n_runs)
    # At most (hot groups + runs) rows: the order is sorted by group first.
    pieces = runs.groupBy(*group, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_start")
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_run")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = pieces.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_run").alias("_piece"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"),
    )
    pieces = F.broadcast(pieces) if fits_broadcast(pieces) else pieces
    same = all_equal(
        {"_run": "_piece", **{g: f"_g{i}" for i, g in enumerate(group)}}, null_safe=True
    )
    spread = runs.join(pieces, same).select(
        *df.columns, (F.col("_row") + F.col("_shift") + 1).cast("bigint").alias(name)
    )
    return ranked.unionByName(spread)


def with_previous(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``prev``, the value of the row before in its group, and ``is_first``.

    ``order`` should be unique in the group. Ordinary groups take one window. Groups
    above ``max_rows`` rows are cut into sorted runs over many tasks; each run then
    learns the last value of the run before.
    """
    by = Window.partitionBy(*key).orderBy(*order)
    cold, hot, n_runs = split_hot(df, key, max_rows)
    seen = cold.withColumns(
        {"prev": F.lag(value).over(by), "is_first": F.row_number().over(by) == 1}
    )
    if hot is None:
        return seen

    runs = sorted_runs(hot, [*key, *order], "previous", n_runs)
    # At most (hot groups + runs) rows, as in group_rank.
    ends = runs.groupBy(*key, "_run").agg(
        F.min("_row").alias("_start"), F.max_by(F.col(value), F.col("_row")).alias("_last")
    )
    earlier = Window.partitionBy(*key).orderBy("_run")
    carried = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col("_run").alias("_piece"),
        F.col("_start"),
        F.lag("_last").over(earlier).alias("_carry"),
        (F.row_number().over(earlier) == 1).alias("_opening"),
    )
    carried = F.broadcast(carried) if fits_broadcast(carried) else carried
    same = all_equal(
        {"_run": "_piece", **{k: f"_k{i}" for i, k in enumerate(key)}}, null_safe=True
    )
    inside = Window.partitionBy("_run", *key).orderBy("_row")
    at_start = F.col("_row") == F.col("_start")
    spread = runs.join(carried, same).withColumn("_before", F.lag(value).over(inside))
    return seen.unionByName(
        spread.select(
            *df.columns,
            F.when(at_start, F.col("_carry")).otherwise(F.col("_before")).alias("prev"),
            (at_start & F.col("_opening")).alias("is_first"),
        )
    )
