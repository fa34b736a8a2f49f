"""First and last lines of files of any length, by seeks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.sources.byte_ranges import lines_between, opened, start_of_last, text_of

_SCHEMA = "path string, rank bigint, offset bigint, line string"
#: Lines of one batch that goes back to Spark.
_BATCH = 10_000


def _batches(path: str, found: Iterator[tuple[int, bytes]]) -> Iterator[pd.DataFrame]:
    rank = 0
    while block := list(islice(found, _BATCH)):
        yield pd.DataFrame(
            {
                "path": path,
                "rank": range(rank + 1, rank + len(block) + 1),
                "offset": [offset for offset, _ in block],
                "line": [text_of(line) for _, line in block],
            }
        )
        rank += len(block)


def file_ends(
    spark: SparkSession,
    path: str,
    n: int,
    last: bool = False,
    glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """The first ``n`` lines of every file, or with ``last`` its last: path, rank, offset, line.

    ``rank`` counts the lines returned of a file from 1, in file order; ``offset`` is the byte at which a
    line begins. Spark lists the files without their contents; a task seeks to the end it was asked for and
    reads whole blocks until it has the lines, so what is read of a file follows the lines returned and
    not its length. A last line without a line end counts. Empty files, or ``n`` of 0, give no
    rows. Files are plain text: a compressed one has no lines at byte positions.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length in zip(batch["path"], batch["length"]):
                with opened(name) as source:
                    start = start_of_last(source, length, n) if last else 0
                    found = lines_between(source, start, length, at_line=True)
                    yield from _batches(name, islice(found, max(n, 0)))

    return files.filter(F.col("length") > 0).mapInPandas(read, _SCHEMA)
