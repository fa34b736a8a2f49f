"""Size checks before a broadcast, joins that use them, and the split of hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.plans.scratch import written

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 5_000_000


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``df``: few enough rows, and few enough bytes with text at its length.

    Rows are counted first, which reads no columns of a plain scan; only a table that
    passes has its texts measured. One number per job reaches the driver.
    """
    flat, lengths = 16, []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.octet_length(column))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            lengths.append(F.octet_length(F.to_json(F.struct(column))))
        else:
            flat += 8
    rows = df.count()
    if rows > max_rows or rows * flat > max_bytes:
        return False
    if not lengths:
        return True
    known = [F.coalesce(n, F.lit(0)).cast("bigint") for n in lengths]
    texts = df.agg(F.sum(reduce(lambda a, b: a + b, known))).first()[0] or 0
    return rows * flat + texts <= max_bytes


def all_equal(pairs: Mapping[str, str], null_safe: bool = False) -> Column:
    """Condition that every left column equals its right column."""
    tests = [
        F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
        for a, b in pairs.items()
    ]
    return reduce(lambda a, b: a & b, tests)


def hot_keys(
    df: DataFrame, keys: Sequence[str], max_rows: int = HOT_ROWS
) -> tuple[DataFrame, int] | None:
    """Keys with more than ``max_rows`` rows as ``_hot0``, ``_hot1``.., and their rows in all.

    Counting combines on the map side, so hot keys do not hurt here, and there are at
    most ``rows / max_rows`` of them. None when there are none.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = counted.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)], "_n")
    if hot.isEmpty():
        return None
    hot = written(hot, "hot-keys")
    rows = hot.agg(F.sum("_n")).first()[0]
    hot = hot.drop("_n")
    return (F.broadcast(hot) if fits_broadcast(hot) else hot), rows


def split_hot(
    df: DataFrame, keys: Sequence[str], max_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None, int]:
    """Split ``df`` into rows of ordinary keys, rows of hot keys, and a number of runs.

    Without hot keys the second part is None. The number says into how many runs the hot
    rows should be cut: about ``max_rows`` rows each.
    """
    found = hot_keys(df, keys, max_rows)
    if found is None:
        return df, None, 0
    hot, rows = found
    same = all_equal({k: f"_hot{i}" for i, k in enumerate(keys)}, null_safe=True)
    n_runs = rows // max_rows + 1
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi"), n_runs


def sized_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    how: str,
    null_safe: bool = False,
    write_first: bool = False,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Inner, left, left_semi or left_anti join; ``on`` maps left to right key columns.

    ``right`` is broadcast when measured small. Beyond the bound it is a shuffle join, and
    left rows of hot keys go apart: they meet only the few right rows of those keys, which
    are measured and broadcast in turn. With ``hot_rows`` None, for left keys known to have
    few rows each, nobody looks for hot keys. The right key columns are dropped.

    ``write_first`` is for a ``right`` that takes work to compute: it is written, so that
    measuring and joining read the result instead of computing it twice.
    """
    if write_first:
        right = written(right, "side")
    names = {r: f"_r{i}" for i, r in enumerate(on.values())}
    right = right.withColumnsRenamed(names)
    keys = {a: names[r] for a, r in on.items()}

    def join(some: DataFrame, side: DataFrame) -> DataFrame:
        return some.join(side, all_equal(keys, null_safe), how).drop(*names.values())

    if fits_broadcast(right, max_rows):
        return join(left, F.broadcast(right))
    found = None if hot_rows is None else hot_keys(left, list(on), hot_rows)
    if found is None:
        return join(left, right)
    hot, _ = found
    on_left = all_equal({k: f"_hot{i}" for i, k in enumerate(on)}, null_safe=True)
    on_right = all_equal({k: f"_hot{i}" for i, k in enumerate(keys.values())}, null_safe=True)
    few = written(right.join(hot, on_right, "left_semi"), "hot-side")
    if fits_broadcast(few, max_rows):
        few = F.broadcast(few)
    cold_rows = join(left.join(hot, on_left, "left_anti"), right)
    return cold_rows.unionByName(join(left.join(hot, on_left, "left_semi"), few))
