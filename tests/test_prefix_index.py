from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import prefix_index
from linewright.plans.scratch import scratch_path

LETTERS = ["a", "b", "ab", "é", "퟿", "￿", "\U0001f600", "\U0010ffff", " "]


def plain(lines, asked, k, empty):
    out = []
    for q in {q for q in asked if q is not None and (q or empty)}:
        found = sorted((x for x in lines if x is not None and x.startswith(q)), key=lambda x: x.encode())
        out += [(q, i, x) for i, x in enumerate(found[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("seed, rows_per_block", [(1, 1), (2, 3), (3, 7), (4, 1000)])
def test_same_as_a_plain_search(spark, seed, rows_per_block):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(n)))
    lines = [word(5) for _ in range(150)] + ["hot"] * 40 + ["", None]
    asked = [word(4) for _ in range(60)] + ["h", "hot", "hot", "hotter", "", None]
    path = scratch_path(spark, "index")
    corpus = spark.createDataFrame([(x, 1) for x in lines], "line string, rank int").repartition(3)
    prefix_index.write_index(corpus, path, rows_per_block=rows_per_block)
    queries = spark.createDataFrame([(x,) for x in asked], "query string")
    for k, empty in ((1, False), (25, True)):
        got = prefix_index.look_up(path, queries, k, empty_asks_all=empty)
        assert got.columns == ["query", "rank", "line"]
        assert sorted((r.query, r.rank, r.line) for r in got.collect()) == plain(lines, asked, k, empty)


def test_empty_index_and_no_queries(spark):
    path, none = scratch_path(spark, "index"), spark.createDataFrame([], "line string")
    prefix_index.write_index(none, path)
    some = spark.createDataFrame([("a",)], "query string")
    assert prefix_index.look_up(path, some, 3, empty_asks_all=True).count() == 0
    path = scratch_path(spark, "index")
    prefix_index.write_index(some, path, line="query")
    assert prefix_index.look_up(path, some.filter("false"), 3).count() == 0


def test_ranges_cover_all_numbers():
    rng = random.Random(5)
    for _ in range(200):
        numbers = sorted(rng.sample(range(60), rng.randrange(1, 30)))
        for most in (1, 2, 5, 100):
            ranges = prefix_index.covering(numbers, most)
            assert len(ranges) <= most
            assert {n for n in numbers if any(a <= n <= b for a, b in ranges)} == set(numbers)
            if most == 100:
                assert sum(b - a + 1 for a, b in ranges) == len(numbers)


def test_one_query_reads_its_row_groups_only(spark):
    """Rows that leave the scan of the blocks, of 200,000 lines in about 780 blocks."""
    path = scratch_path(spark, "index")
    # Lines that do not compress, so that there are several row groups and files.
    corpus = spark.range(200_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512)).alias("line"))
    prefix_index.write_index(corpus, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() == -(-200_000 // 256)
    touched = prefix_index._touched(blocks, spark.createDataFrame([(400,)], "block bigint"))
    text = touched._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block,400), LessThanOrEqual(block,400)" in text
    # Without the filter above the scan, what the scan itself returns are whole row groups.
    rows = touched._jdf.queryExecution().executedPlan()
    touched.collect()
    scans = [n for n in _nodes(rows) if "Scan" in n.nodeName()]
    read = sum(n.metrics().apply("numOutputRows").value() for n in scans)
    assert 1 <= read <= 200


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    out, children = [plan], plan.children()
    for i in range(children.size()):
        out += _nodes(children.apply(i))
    return out
