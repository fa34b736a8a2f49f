"""Follow files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Stream of the rows of files that appear in ``path``, or with ``recursive`` in its folders.

    New files are seen, bytes added to a file already read are not. ``glob`` chooses among the
    names of files, not of folders.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def land(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream to a parquet table, each row exactly once."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
