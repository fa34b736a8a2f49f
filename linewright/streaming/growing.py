"""Follow the bytes added to files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linewright.sources.byte_ranges import end_of_lines, lines_between, located, opened, text_of

SCHEMA = "path string, offset bigint, line string"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("line", pa.string())])
_BATCH = 10_000


@dataclass
class _Range(InputPartition):
    """Bytes of one file; ``at_line`` if ``start`` is known to begin a line."""

    path: str
    start: int
    stop: int
    at_line: bool


class _GrowingReader(DataSourceStreamReader):
    """An offset is, for each file, the place after its last whole line."""

    def __init__(self, folder: str, glob: str | None, recursive: bool, block: int):
        self.folder, self.glob, self.recursive, self.block = folder, glob, recursive, block
        self.seen: dict[str, tuple[int, int]] = {}  # path -> (size, offset) at the last look

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, inner = located(self.folder)
        found = store.get_file_info(
            pafs.FileSelector(inner, allow_not_found=True, recursive=self.recursive)
        )
        scheme = self.folder[: self.folder.index(inner)] if inner in self.folder else ""
        ends, seen = {}, {}
        for info in found:
            below = info.path[len(inner) :]
            hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
            if not info.is_file or hidden or not fnmatchcase(info.base_name, self.glob or "*"):
                continue
            path, size = scheme + info.path, info.size
            before, end = self.seen.get(path, (0, 0))
            if size < before:
                end = 0
            if size != before:
                with opened(path) as source:
                    end = end_of_lines(source, end, size)
            seen[path] = size, end
            if end:
                ends[path] = end
        self.seen = seen
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            if stop < first:  # cut off and written anew
                first = 0
            for place in range(first, stop, self.block):
                ranges.append(_Range(path, place, min(place + self.block, stop), place == first))
        return ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as source:
            found = lines_between(source, partition.start, partition.stop, partition.at_line)
            while block := list(islice(found, _BATCH)):
                offsets = [offset for offset, _ in block]
                texts = [text_of(line) for _, line in block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * len(block)), pa.array(offsets, pa.int64()), pa.array(texts)],
                    schema=_ARROW,
                )


class GrowingLines(DataSource):
    """The streaming source of ``tail_files``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(
            self.options["path"].rstrip("/"),
            self.options.get("glob"),
            self.options.get("recursive") == "true",
            int(self.options["blockBytes"]),
        )


def tail_files(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    recursive: bool = False,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """Stream of the lines that are added to the files of a folder: path, offset, line.

    New files are read from their beginning, known ones from where the last batch ended; each whole
    line comes once, with the byte at which it begins. The rest after the last line end waits
    until its line end is written. A file that got shorter than what was read of it is read anew from its
    beginning; one that is replaced by a longer one cannot be told from one that grew. Names
    that begin with ``_`` or ``.`` are left out, as Spark does.

    The bytes between two offsets are cut into ranges of ``block_bytes``, read by tasks of their own, so
    a long file, or a long backlog, is no single task. Offsets are in the query's checkpoint; a
    batch run again reads the same bytes. An offset has one number per file, and the folder is listed at each
    trigger: for folders of very many files that never grow, use ``follow_files``.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes must be at least 1")
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(GrowingLines.name()).option("blockBytes", block_bytes)
    if glob:
        reader = reader.option("glob", glob)
    return reader.option("recursive", recursive).load(path)
