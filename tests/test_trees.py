from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import rights
from linewright.plans import sizing
from linewright.plans.scratch import scratch_path
from linewright.sources import listing, sinks


@pytest.fixture
def tree(tmp_path):
    for folder in ("a/b/c", "a/empty", "d e%20", "_hidden/x", "a/.git"):
        (tmp_path / folder).mkdir(parents=True)
    sizes = {"top": 1, "a/f": 10, "a/b/g": 100, "a/b/c/h": 0, "a/b/c/i": 1000, "d e%20/j": 10_000}
    for name, size in {**sizes, "_hidden/x/k": 7, "a/.git/l": 7, "_SUCCESS": 7}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path), sizes


@pytest.mark.parametrize("hidden", [False, True])
def test_walk_is_what_os_walk_finds(spark, tree, hidden):
    root, _ = tree
    want = set()
    for folder, folders, files in os.walk(root):
        if not hidden:
            folders[:] = [f for f in folders if f[0] not in "_."]
            files = [f for f in files if f[0] not in "_."]
        depth = folder[len(root) :].count("/") + 1
        want |= {(folder, f, f"{folder}/{f}", True, None, depth) for f in folders}
        want |= {
            (folder, f, f"{folder}/{f}", False, os.path.getsize(f"{folder}/{f}"), depth) for f in files
        }
    rows = listing.walk(spark, root + "/", hidden=hidden).collect()
    got = [(r.parent, r.name, r.path, r.is_dir, r.length, r.depth) for r in rows]
    assert len(got) == len(want) and set(got) == want
    times = {r.path: r.modificationTime.timestamp() for r in rows if not r.is_dir}
    assert all(abs(os.path.getmtime(p) - t) < 1 for p, t in times.items())
    once = listing.walk(spark, root, max_depth=1, hidden=hidden).collect()
    assert {r.path for r in once} == {r.path for r in rows if r.depth == 1}


def test_totals_count_empty_folders_and_the_root(spark, tree):
    root, sizes = tree
    totals = listing.folder_totals(listing.walk(spark, root), root)
    got = {r.path[len(root) + 1 :]: (r.n_files, r.n_folders, r.length) for r in totals.collect()}
    assert got == {
        "": (6, 5, sum(sizes.values())),
        "a": (4, 3, 1110),
        "a/b": (3, 1, 1100),
        "a/b/c": (2, 0, 1000),
        "a/empty": (0, 0, 0),
        "d e%20": (1, 0, 10_000),
    }


def test_an_empty_root_and_a_missing_one(spark, tmp_path):
    (tmp_path / "none").mkdir()
    found = listing.walk(spark, str(tmp_path / "none"))
    assert found.count() == 0
    totals = listing.folder_totals(found, str(tmp_path / "none")).collect()
    assert [(r.n_files, r.n_folders, r.length) for r in totals] == [(0, 0, 0)]
    with pytest.raises(Exception, match="gone"):
        listing.walk(spark, str(tmp_path / "gone"))


def nearest(path, rules):
    """Plain loop over the folders of a path, from the path itself up."""
    if path is None:
        return None, None
    parts = [p for p in path.split("/") if p]
    for n in range(len(parts), -1, -1):
        held = [(at, owner) for at, (rule, owner) in enumerate(rules)
                if rule is not None and [p for p in rule.split("/") if p] == parts[:n]]
        if held:
            return n, max(held)[1]
    return None, None


@pytest.mark.parametrize("small", [True, False])
def test_rights_come_from_the_nearest_folder(spark, monkeypatch, small):
    if not small:  # no broadcast, and every folder is a hot key
        monkeypatch.setattr(sizing.sized_join, "__defaults__", (False, False, 0, 3))
    rng = random.Random(4)

    def path():
        return rng.choice(["", "/"]) + "/".join(rng.choice("ab") for _ in range(rng.randrange(5)))

    found = [(i, path()) for i in range(200)] + [(200, None), (201, "ab/a"), (202, "//a//b/")]
    rules = [(path(), f"o{i}") for i in range(12)] + [(None, "nobody"), ("/a/", None)]
    for some in (rules, [r for r in rules if r[0] and r[0].strip("/")], []):
        df = spark.createDataFrame(found, "id int, path string")
        side = spark.createDataFrame([(i, *r) for i, r in enumerate(some)], "at int, path string, owner string")
        held = rights.inherit(df, F.col("path"), side, F.col("path"), ["owner"], order="at")
        assert held.columns == ["id", "path", "rule_depth", "owner"]
        got = {r.id: (r.rule_depth, r.owner) for r in held.collect()}
        assert got == {i: nearest(p, some) for i, p in found}


def test_both_routes_are_written_in_one_pass(spark):
    rows = [(i, None if i % 5 == 0 else i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, ok boolean").repartition(7)
    reads = spark.sparkContext.accumulator(0)
    out = scratch_path(spark, "routes")

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    counts = sinks.write_routes(df.mapInArrow(seen, df.schema), F.col("ok"), out)
    back = spark.read.parquet(out).withColumn("accepted", F.col("accepted").cast("boolean"))
    assert counts == {"accepted": back.filter("accepted").count(), "rejected": back.filter("NOT accepted").count()}
    assert {(r.id, r.accepted) for r in back.collect()} == {(i, bool(ok)) for i, ok in rows}
    assert reads.value == 100
    assert sorted(f for f in os.listdir(out) if "=" in f) == ["accepted=false", "accepted=true"]
    with pytest.raises(ValueError, match="already"):
        sinks.write_routes(back, F.lit(True), out)
