"""Append, copy, rewrite and XML export of whole tables."""

from __future__ import annotations

import posixpath
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_table(path: str, *sources: DataFrame, fmt: str = "parquet") -> None:
    """Add the rows of all sources to a table in one write, creating it when missing."""
    rows = reduce(DataFrame.unionByName, sources)
    rows.write.mode("append").format(fmt).save(path)


def write_routes(
    df: DataFrame, accepted: Column, path: str, fmt: str = "parquet", column: str = "accepted"
) -> dict[str, int]:
    """Write accepted and rejected rows to two folders of one table in one pass over ``df``.

    ``column`` is the partition column, with folders ``true`` and ``false`` (Spark reads them back as
    strings); a condition that is NULL rejects. Returns the
    rows of either route, ``accepted`` and ``rejected``, counted by the tasks that write them, so
    nothing is read a second time. An existing table is refused.
    """
    if column in df.columns:
        raise ValueError(f"there is a column {column} already")
    seen = Observation()
    routed = df.withColumn(column, F.coalesce(accepted, F.lit(False))).observe(
        seen,
        F.count_if(F.col(column)).alias("accepted"),
        F.count_if(~F.col(column)).alias("rejected"),
    )
    routed.write.partitionBy(column).format(fmt).save(path)
    return seen.get


def copy_table(
    spark: SparkSession,
    src: str,
    dst: str | None = None,
    cwd: str | None = None,
    force: bool = False,
    src_format: str = "parquet",
    dst_format: str = "parquet",
) -> str:
    """Copy a table, converting the format on request; returns the target path.

    Without ``dst`` the copy goes to ``cwd``, which then has to be given, under its own name. An
    existing target is refused unless ``force`` is set.
    """
    if dst is None and cwd is None:
        raise ValueError("a target or a working folder is needed")
    target = dst or posixpath.join(cwd, posixpath.basename(src.rstrip("/")))
    mode = "overwrite" if force else "errorifexists"
    spark.read.format(src_format).load(src).write.mode(mode).format(dst_format).save(target)
    return target


def rewrite_table(df: DataFrame, name: str, root: str, fmt: str = "parquet") -> str | None:
    """Replace the catalog table ``name`` with ``df``, which may itself read the table.

    The new version is written whole to a folder of its own under ``root``, and the catalog
    then points to it, in one step: there is always a whole table, on object stores too, and
    nothing is renamed. Returns the folder of the version before, for the caller to delete
    once no reader is left.
    """
    spark = df.sparkSession
    fresh = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(fresh)
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=fresh, source=fmt)
        return None
    details = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{fresh}'")
    spark.catalog.refreshTable(name)
    return details["data_type"]


PROPERTY = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]
)


def xml_export(
    df: DataFrame, path: str, root: str = "configuration", row: str = "property"
) -> None:
    """Write name/value rows as XML: one ``row`` element per row, values as text.

    NULL writes no element and an empty text an empty one, so that both come back as they were.
    """
    df.select(*[F.col(c).cast("string") for c in df.columns]).write.format("xml").option(
        "rootTag", root
    ).option("rowTag", row).save(path)


def xml_import(
    spark: SparkSession, path: str, schema: T.StructType = PROPERTY, row: str = "property"
) -> DataFrame:
    """Read what ``xml_export`` wrote. The schema is given, so "1" stays text."""
    return spark.read.format("xml").schema(schema).option("rowTag", row).option(
        "ignoreSurroundingSpaces", False
    ).load(path)
