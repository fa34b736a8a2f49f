"""Shared scratch space and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


#: Paths of ``written`` tables, one list per ``settled`` call that is under way.
_MADE: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names, else its warehouse.

    A warehouse on a local disk, which is Spark's default, is refused on a cluster: its
    machines do not see one another's disks.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    root = spark.conf.get(WAREHOUSE_CONF).rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if root.startswith(("file:", "/")) and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{CHECKPOINT_CONF} is not set, and {WAREHOUSE_CONF} is a local folder: {root}")
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path per call, so reruns never meet older output."""
    return f"{scratch_root(spark)}/linewright/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, and values such as
    generated ids stay the same in every later use.
    """
    path = scratch_path(df.sparkSession, label)
    for made in _MADE:
        made.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever file system it is on; one that is gone already is no error."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing lazy reads any more."""
    remove(table.sparkSession, table._scratch_path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write what ``make`` returns, then delete every table that ``make`` itself has written."""
    _MADE.append([])
    try:
        result = make()
    finally:
        made = _MADE.pop()
    table = written(result, label)
    for path in made:
        remove(table.sparkSession, path)
    return table
