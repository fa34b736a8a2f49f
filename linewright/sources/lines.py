"""Line views of texts and files.

A document is kept *packed*, one row with an array of its lines, as long as it is
edited: line edits then run inside the row. ``unpacked`` gives one row per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.functions.text import split_lines
from linewright.plans.scratch import written
from linewright.plans.sizing import sized_join


def packed(
    df: DataFrame, keys: Sequence[str], text: str = "text", holding: str | None = None
) -> DataFrame:
    """``keys`` plus ``lines array<string>``; no shuffle.

    ``holding`` keeps only texts with that literal, for a search that needs no other
    text: they are left out before they are split.
    """
    if holding is not None:
        df = df.filter(F.contains(F.col(text), F.lit(holding)))
    return df.select(*keys, split_lines(F.col(text)).alias("lines"))


def unpacked(df: DataFrame, lines: str = "lines") -> DataFrame:
    """One row per line: the other columns, ``pos`` from 0, ``line``."""
    others = [c for c in df.columns if c != lines]
    # The outer form keeps Catalyst from inferring a size filter on the array, which
    # would be pushed below and split every text a second time.
    rows = df.select(*others, F.posexplode_outer(lines).alias("pos", "line"))
    return rows.filter(F.col("pos").isNotNull())


def line_scan(
    df: DataFrame, keys: Sequence[str], text: str = "text", holding: str | None = None
) -> DataFrame:
    """Ordered lines of a text column: ``keys``, ``pos``, ``line``."""
    return unpacked(packed(df, keys, text, holding))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ordered lines of text files small enough for one cell: ``path``, ``pos``, ``line``."""
    files = spark.read.text(paths, wholetext=True)
    return line_scan(
        files.select(F.col("_metadata.file_path").alias("path"), "value"), ["path"], "value"
    )


def scan_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ordered lines of text files of any length: ``path``, ``pos``, ``line``.

    Files are read in blocks by many tasks, and no file is ever one cell. Lines get an id
    in reading order and are written once; ``pos`` is the place in the block plus the
    lines of the blocks before it in the file.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    rows = written(rows, "file-lines")
    # One row per file block read.
    blocks = rows.groupBy("path", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_start")
    )
    earlier = (
        Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = blocks.select(
        "path",
        "_block",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"),
    )
    placed = sized_join(rows, shifts, {"path": "path", "_block": "_block"}, "inner", hot_rows=None)
    return placed.select("path", (F.col("_id") + F.col("_shift")).alias("pos"), "line")


def concat_sources(
    sources: Sequence[tuple[str, DataFrame]], order: Sequence[Column | str]
) -> DataFrame:
    """All rows of several sources, in order, duplicates kept.

    Adds ``src_no`` (place of the source) and ``src`` (its tag). ``order`` columns exist
    in every source and give the order inside it: the whole order is
    ``(src_no, *order)``.
    """
    if not sources:
        raise ValueError("no sources")
    tagged = [
        df.select(F.lit(i).cast("bigint").alias("src_no"), F.lit(tag).alias("src"), *order, "text")
        for i, (tag, df) in enumerate(sources)
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
