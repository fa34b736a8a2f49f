"""Python over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers.

    They import it by name, and may have been started in any folder. Where executors have it by
    other means, the path is simply not there.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def mapped(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``df.mapInArrow``, with this package on the path of the Python workers."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, by: Sequence[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``applyInArrow`` on the groups of ``by``, likewise. A group has to fit a task."""
    importable(df.sparkSession)
    return df.groupBy(*by).applyInArrow(run, schema)
