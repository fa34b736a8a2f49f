from __future__ import annotations

import io
import os
import random

import pytest

from linewright.plans.scratch import scratch_path
from linewright.sources import byte_ranges
from linewright.sources.ends import file_ends
from linewright.streaming import follow, growing


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    n = 0

    def read(self, size=-1):
        got = super().read(size)
        self.n += len(got)
        return got

    def readinto(self, buffer):
        got = super().readinto(buffer)
        self.n += got
        return got


def whole_lines(data: bytes) -> list[tuple[int, bytes]]:
    out, place = [], 0
    for line in data.splitlines(keepends=True) if b"\r" not in data else io.BytesIO(data):
        out.append((place, line))
        place += len(line)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_ranges_share_no_line_and_leave_none_out(seed):
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\n\n"]) for _ in range(rng.randrange(60)))
    for step in (1, 2, 3, 7, 100):
        got = [
            pair
            for start in range(0, len(data), step)
            for pair in byte_ranges.lines_between(
                io.BytesIO(data), start, min(start + step, len(data)), at_line=False
            )
        ]
        assert got == whole_lines(data)


@pytest.mark.parametrize("look", [1, 2, 3, 1 << 16])
def test_last_lines_begin_where_a_plain_split_says(monkeypatch, look):
    monkeypatch.setattr(byte_ranges, "LOOK", look)
    for data in (b"", b"a", b"a\n", b"\n", b"\n\n", b"a\nb", b"a\nb\n", b"\n\na\n\nbb\n\n", b"x\r\ny\r\n"):
        lines = whole_lines(data)
        for n in range(6):
            start = byte_ranges.start_of_last(io.BytesIO(data), len(data), n)
            assert start == (lines[-n:][0][0] if n and lines else len(data)), (data, n)
        ends = [i + 1 for i in range(len(data)) if data[i : i + 1] == b"\n"]
        assert byte_ranges.end_of_lines(io.BytesIO(data), 0, len(data)) == (ends[-1] if ends else 0)


def test_reading_follows_the_lines_and_not_the_length():
    data = Counted(b"0123456789\n" * 1_000_000)
    start = byte_ranges.start_of_last(data, 11_000_000, 5)
    assert start == 11_000_000 - 55
    assert data.n <= 2 * byte_ranges.LOOK


def test_paths_as_spark_shows_them(tmp_path):
    for path in (f"{tmp_path}/a b%20c", f"file:{tmp_path}/a b%20c", f"file://{tmp_path}/a b%20c"):
        assert byte_ranges.located(path)[1] == f"{tmp_path}/a b%20c"


def test_ends_of_files(spark, tmp_path):
    long = [f"line {i}" for i in range(30_000)]
    files = {"a.log": "\n".join(long), "b.log": "one\r\ntwo\r\n", "c d%20.log": "x", "e.log": "", "f.txt": "no\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data.encode())

    def got(n, **more):
        rows = file_ends(spark, str(tmp_path), n, glob="*.log", **more).collect()
        out = {}
        for r in sorted(rows, key=lambda r: (r.path, r.rank)):
            name = os.path.basename(r.path)
            out.setdefault(name, []).append(r.line)
            assert r.rank == len(out[name])
            assert files[name].encode()[r.offset :].startswith(r.line.encode())
        return out

    assert got(2) == {"a.log": long[:2], "b.log": ["one", "two"], "c d%20.log": ["x"]}
    assert got(2, last=True) == {"a.log": long[-2:], "b.log": ["one", "two"], "c d%20.log": ["x"]}
    assert got(1, last=True) == {"a.log": long[-1:], "b.log": ["two"], "c d%20.log": ["x"]}
    assert got(25_000, last=True)["a.log"] == long[-25_000:]
    assert got(0) == got(0, last=True) == {}


def test_lines_added_between_triggers_land_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, mark = scratch_path(spark, "tail-out"), scratch_path(spark, "tail-mark")

    def run(block=5):
        stream = growing.tail_files(spark, str(inbox), glob="*.log", recursive=True, block_bytes=block)
        query = follow.land(stream, out, mark)
        query.awaitTermination()
        rows = spark.read.schema(growing.SCHEMA).parquet(out).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.path, r.offset)):
            got.setdefault(os.path.relpath(r.path, inbox), []).append(r.line)
        return got

    log = inbox / "a.log"
    log.write_bytes("eins\nzwei\ndr".encode())
    (inbox / "skip.txt").write_bytes(b"no\n")
    (inbox / "_hidden.log").write_bytes(b"no\n")
    assert run() == {"a.log": ["eins", "zwei"]}
    assert run() == {"a.log": ["eins", "zwei"]}
    with log.open("ab") as f:
        f.write("ei\n\nfünf".encode())
    (inbox / "sub").mkdir()
    (inbox / "sub" / "b.log").write_bytes(b"x\r\ny\n")
    assert run(1) == {"a.log": ["eins", "zwei", "drei", ""], "sub/b.log": ["x", "y"]}
    # One commit is lost: the batch runs again and nothing comes twice.
    commits = sorted(int(n) for n in os.listdir(f"{mark}/commits") if n.isdigit())
    os.remove(f"{mark}/commits/{commits[-1]}")
    if os.path.exists(f"{mark}/commits/.{commits[-1]}.crc"):
        os.remove(f"{mark}/commits/.{commits[-1]}.crc")
    with log.open("ab") as f:
        f.write(b"\n")
    assert run(64)["a.log"] == ["eins", "zwei", "drei", ""]  # this run ends the lost batch
    assert run(64)["a.log"] == ["eins", "zwei", "drei", "", "fünf"]
    log.write_bytes(b"new\n")  # cut off and written anew
    assert sorted(run(64)["a.log"]) == sorted(["eins", "zwei", "drei", "", "fünf", "new"])


def test_ranges_of_a_backlog_are_cut(spark):
    reader = growing._GrowingReader("/x", None, False, 10)
    cut = reader.partitions({"a": 5, "b": 9, "c": 7}, {"a": 27, "b": 9, "c": 3})
    assert [(r.path, r.start, r.stop, r.at_line) for r in cut] == [
        ("a", 5, 15, True),
        ("a", 15, 25, False),
        ("a", 25, 27, False),
        ("c", 0, 3, True),
    ]
