"""Files read by byte position, inside tasks.

Paths are those that Spark shows, in a store that pyarrow opens too (local and mounted folders,
``hdfs``, ``s3``, ``gs``, ``abfs``). Lines end with ``\\n`` or ``\\r\\n``; bytes that are not UTF-8
become replacement characters.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow.fs as pafs

#: Bytes of one look backwards for a line end.
LOOK = 1 << 16


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path inside it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), path[len("file:") :].replace("//", "", 1) if (
            path.startswith("file://")
        ) else path.removeprefix("file:")
    return pafs.FileSystem.from_uri(quote(path, safe="/:@%"))


def opened(path: str) -> BinaryIO:
    store, inner = located(path)
    return store.open_input_file(inner)


def text_of(line: bytes) -> str:
    line = line.removesuffix(b"\n").removesuffix(b"\r")
    return line.decode("utf-8", errors="replace")


def lines_between(source: BinaryIO, start: int, stop: int, at_line: bool) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines that begin in ``[start, stop)``.

    Neighbouring ranges share no line and leave none out: unless ``at_line``, what comes before
    the first line end from ``start - 1`` on belongs to the range before.
    """
    place = start if at_line or start == 0 else start - 1
    source.seek(place)
    reader = io.BufferedReader(source, 1 << 20)
    if place < start:
        place += len(reader.readline())
    while place < stop:
        line = reader.readline()
        if not line:
            return
        yield place, line
        place += len(line)


def end_of_lines(source: BinaryIO, floor: int, size: int) -> int:
    """The place after the last line end in ``[floor, size)``, else ``floor``; reads backwards."""
    stop = size
    while stop > floor:
        start = max(floor, stop - LOOK)
        source.seek(start)
        found = source.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return floor


def start_of_last(source: BinaryIO, size: int, n: int) -> int:
    """Where the last ``n`` lines begin; reads backwards and no further than their beginning.

    A line end at the very end of the file ends the last line and begins none.
    """
    if n <= 0 or size == 0:
        return size
    stop, missing, end = size, n, size
    while stop > 0:
        start = max(0, stop - LOOK)
        source.seek(start)
        block = source.read(stop - start)
        cut = len(block)
        while (cut := block.rfind(b"\n", 0, cut)) >= 0:
            if start + cut + 1 == end:
                continue
            missing -= 1
            if missing == 0:
                return start + cut + 1
        stop = start
    return 0
