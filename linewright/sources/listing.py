"""Directory listings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.plans.scratch import settled, written
from linewright.sources.byte_ranges import located

_ORDERS = {"name": [("path", False)], "time": [("modificationTime", True)], "size": [("length", True)]}


def human_size(length: Column) -> Column:
    """Bytes with a binary prefix and one decimal: ``512``, ``1.5 K``, ``64.0 M``."""
    size = length.cast("string")
    for power, prefix in enumerate("KMGTPE", start=1):
        unit = float(1024**power)
        text = F.format_string(f"%.1f {prefix}", length / F.lit(unit))
        size = F.when(length >= F.lit(unit), text).otherwise(size)
    return size


def file_catalog(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    recursive: bool = False,
    sort: str = "name",
    reverse: bool = False,
    names_only: bool = False,
    human: bool = False,
    folders: bool = False,
) -> DataFrame:
    """List files: path, modification time, length; ``human`` adds a readable ``size``.

    ``recursive`` also lists the files in folders, as those of tables are. ``folders`` lists the
    folders that hold files instead, with the newest time and all bytes in them. ``sort`` is
    ``name``, ``time`` (newest first) or ``size`` (largest first); ``reverse`` turns it round.
    File contents are never selected, so they are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "modificationTime", "length")
    if folders:
        above = F.regexp_replace("path", "/[^/]*$", "")
        files = files.groupBy(above.alias("path")).agg(
            F.max("modificationTime").alias("modificationTime"), F.sum("length").alias("length")
        )
    keys = [
        F.col(c).desc() if down != reverse else F.col(c).asc()
        for c, down in [*_ORDERS[sort], *([] if sort == "name" else [("path", False)])]
    ]
    files = files.orderBy(*keys)
    if human:
        files = files.withColumn("size", human_size(F.col("length")))
    return files.select("path") if names_only else files


_ENTRY = (
    "parent string, name string, path string, is_dir boolean, length bigint, "
    "modificationTime timestamp, depth int"
)
#: Entries of one folder that go back to Spark at a time.
_BATCH = 10_000


def walk(
    spark: SparkSession, root: str, max_depth: int | None = None, hidden: bool = False
) -> DataFrame:
    """Files and folders below ``root``, empty folders too.

    Output: parent, name, path, is_dir, length (null for folders), modificationTime, depth (1 for the
    entries of ``root``). ``max_depth`` 1 lists one folder. Names that begin with ``_`` or ``.`` are
    left out, and all below them, unless ``hidden``.

    One level of folders at a time is dealt out over the tasks, each folder listed by one
    task; the driver learns only whether a level has folders. Every level is written once, so a lost
    executor repeats the listing of its own folders. A missing root stops the job.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def level(folders: DataFrame, depth: int) -> DataFrame:
        def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for folder in (f for batch in batches for f in batch["path"]):
                store, inner = located(folder)
                found = [
                    info
                    for info in store.get_file_info(pafs.FileSelector(inner))
                    if hidden or not info.base_name.startswith(("_", "."))
                ]
                for start in range(0, len(found), _BATCH):
                    some = found[start : start + _BATCH]
                    yield pd.DataFrame(
                        {
                            "parent": folder,
                            "name": [i.base_name for i in some],
                            "path": [f"{folder}/{i.base_name}" for i in some],
                            "is_dir": [not i.is_file for i in some],
                            "length": pd.array([i.size for i in some], dtype="Int64"),
                            "modificationTime": pd.to_datetime([i.mtime for i in some], utc=True),
                            "depth": depth,
                        }
                    )

        return written(folders.select("path").mapInPandas(entries, _ENTRY), "level")

    def levels() -> DataFrame:
        made = [level(spark.createDataFrame([(root.rstrip("/"),)], "path string"), 1)]
        while len(made) != max_depth:
            folders = made[-1].filter("is_dir")
            if folders.isEmpty():
                break
            made.append(level(folders.repartition(tasks), len(made) + 1))
        return reduce(DataFrame.unionByName, made)

    return settled(levels, "tree")


def folder_totals(entries: DataFrame, root: str) -> DataFrame:
    """All that lies at or below each folder of ``walk``: path, n_files, n_folders, length.

    ``root`` is the one that was walked and is listed too, as are empty folders. Entries are summed per
    parent, combining before the shuffle, and only those sums go to the folders above.
    """
    root = root.rstrip("/")
    file = ~F.col("is_dir")
    sums = entries.groupBy("parent").agg(
        F.count_if(file).alias("n_files"),
        F.count_if("is_dir").alias("n_folders"),
        F.coalesce(F.sum(F.when(file, F.col("length"))), F.lit(0)).alias("length"),
    )
    parts = F.split(F.substr("parent", F.lit(len(root) + 2)), "/")
    n_parts = F.when(F.col("parent") == root, F.lit(0)).otherwise(F.size(parts))
    above = F.transform(
        F.sequence(F.lit(0), n_parts),
        lambda n: F.concat_ws("/", F.lit(root), F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), n), "/"))),
    )
    spread = sums.select(F.explode(above).alias("path"), "n_files", "n_folders", "length")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("n_files", "n_folders", "length")]
    known = entries.filter("is_dir").select("path", *zero)
    top = entries.sparkSession.range(1).select(F.lit(root).alias("path"), *zero)
    return (
        spread.unionByName(known)
        .unionByName(top)
        .groupBy("path")
        .agg(*[F.sum(c).alias(c) for c in ("n_files", "n_folders", "length")])
    )
