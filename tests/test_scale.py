"""Hot groups, size checks and plans."""

from __future__ import annotations

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as contract
from linewright.queries import BINDINGS
from linewright.operators import aggregates, joins
from linewright.operators.changes import change_log
from linewright.plans import ranking, scratch, sizing
from linewright.plans.scratch import scratch_root
from linewright.sources import listing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many small groups, a NULL group."""
    rng = random.Random(11)
    rows = [("hot", i, rng.choice(["a", "b", None])) for i in range(900)]
    rows += [(f"g{rng.randint(0, 200)}", 1000 + i, rng.choice("ab")) for i in range(1700)]
    rows += [(None, 5000 + i, rng.choice("ab")) for i in range(100)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v string")


def test_split_hot_keeps_every_row(skewed):
    cold, hot, n_runs = sizing.split_hot(skewed, ["k"], 50)
    assert {r.k for r in hot.select("k").distinct().collect()} == {"hot", None}
    assert cold.count() + hot.count() == skewed.count()
    assert n_runs == 1000 // 50 + 1
    assert sizing.split_hot(skewed, ["k"], 5000)[1] is None


def test_group_rank_of_hot_groups(skewed):
    window = Window.partitionBy("k").orderBy("t")
    want = skewed.withColumn("rank", F.row_number().over(window).cast("bigint"))
    got = ranking.group_rank(skewed, ["k"], ["t"], max_rows=50)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_spread_over_tasks(skewed):
    _, hot, n_runs = sizing.split_hot(skewed, ["k"], 50)
    runs = ranking.sorted_runs(hot, ["k", "t"], "test", n_runs)
    sizes = [r["count"] for r in runs.groupBy("_run").count().collect()]
    assert len(sizes) > n_runs // 2
    assert max(sizes) < 1000 // 4


@pytest.mark.parametrize("limit", [50, 5000])
def test_change_log_with_hot_keys(skewed, limit):
    by_key: dict = {}
    for r in sorted(skewed.collect(), key=lambda r: r.t):
        by_key.setdefault(r.k, []).append((r.t, r.v))
    want = {
        (k, t, v, p)
        for k, seen in by_key.items()
        for (_, p), (t, v) in zip(seen, seen[1:])
        if p != v
    }
    got = change_log(skewed, ["k"], ["t"], "v", max_rows=limit).collect()
    assert {(r.k, r.t, r.v, r.prev) for r in got} == want
    assert len(got) == len(want)


def test_global_rank_with_one_frequent_value(spark):
    rows = [("same", i) for i in range(600)] + [(f"w{i}", i) for i in range(300)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "w string, i int")
    got = ranking.global_rank(frame, ["w", "i"]).orderBy("rank").collect()
    assert [(r.w, r.i) for r in got] == sorted(rows)
    assert [r.rank for r in got] == list(range(1, 901))


def test_size_check_counts_rows_and_bytes(spark):
    frame = spark.createDataFrame([("x" * 100,)] * 10, "s string")
    assert sizing.fits_broadcast(frame)
    assert not sizing.fits_broadcast(frame, max_rows=9)
    assert not sizing.fits_broadcast(frame, max_bytes=999)


def test_scratch_is_the_folder_of_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_scratch_falls_back_to_the_warehouse():
    known = {"spark.sql.warehouse.dir": "file:/shared/warehouse/"}
    conf = SimpleNamespace(get=lambda key, default=None: known.get(key, default))
    assert scratch_root(SimpleNamespace(conf=conf)) == "file:/shared/warehouse"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


IN_ROW = [
    "line_scan", "grep_lines", "grep_context", "rewrite_lines", "rewrite_lines_all",
    "collapse_repeats", "insert_before_marker", "cut_between_markers", "block_upsert",
    "head_lines", "tail_lines", "extract_fields", "fan_out", "token_columns", "url_path_profile",
    "split_explode", "truncate_text", "validate_route", "parse_aliases", "ensure_element",
]


@pytest.mark.parametrize("name", IN_ROW)
def test_edits_in_a_row_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(contract.queries()[name](spark, SF_DIR))


# Seeks into files have no built-in form.
SEEKS = {"file_ends"}


@pytest.mark.parametrize("name", sorted(set(BINDINGS) - SEEKS))
def test_no_pairwise_joins_and_no_python_in_plans(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in text
    # One-task exchanges: only of one row per task, in a subquery that collects lengths.
    single = text.count("Exchange SinglePartition")
    assert single <= text.count("collect_set"), text


def test_literal_search_is_pushed_down(spark):
    text = plan(contract.queries()["grep_context"](spark, SF_DIR))
    assert "StringContains(text,@)" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_first_hit_is_searched_once_per_document(spark):
    text = plan(contract.queries()["rewrite_lines"](spark, SF_DIR))
    assert text.count("array_position") == 1
    assert "lambdafunction(CASE WHEN (cast((lambda" in text
    assert "= array_position" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("kth_match", "head_tail", "prefix_complete"):
        text = plan(contract.queries()[name](spark, SF_DIR))
        assert "Partial" in text and "WindowGroupLimit" in text, name


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    text = plan(listing.file_catalog(spark, str(tmp_path)))
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in text


def test_equal_lines_spread_over_runs(spark):
    lines = spark.createDataFrame([("same",)] * 20_000, "line string").repartition(8)
    runs = ranking.sorted_runs(lines, ["line"], "equal", 8).groupBy("_run").count().collect()
    assert max(r["count"] for r in runs) <= 2 * 20_000 / 8


def test_no_sort_before_the_exchange(spark):
    src = spark.range(9).selectExpr("id AS k", "cast(id AS string) AS v")
    for df in (joins.sync_delta(src, src, ["k"]), aggregates.merge_last_wins([src, src], ["k"], "v")):
        lines = plan(df).split("\n")
        exchanges = [i for i, line in enumerate(lines) if "Exchange hash" in line]
        assert exchanges and not any("Sort" in line for line in lines[exchanges[-1] + 1 :])
        depth = min(len(lines[i]) - len(lines[i].lstrip(" :+-")) for i in exchanges)
        below = [line for line in lines if "Sort" in line and len(line) - len(line.lstrip(" :+-")) > depth]
        assert not below


@pytest.mark.parametrize("root", ["file:/one/machine", "/one/machine"])
def test_no_local_scratch_on_a_cluster(root):
    def session(settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: settings.get(name, default)))

    settings = {"spark.sql.warehouse.dir": root, "spark.master": "spark://head:7077"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(session(settings))
    assert scratch.scratch_root(session(settings | {"spark.master": "local[4]"})) == root
    assert scratch.scratch_root(session(settings | {"spark.checkpoint.dir": "/shared/"})) == "/shared"
    assert scratch.scratch_root(session(settings | {"spark.sql.warehouse.dir": "hdfs://x/w/"})) == "hdfs://x/w"


def test_a_settled_step_leaves_its_result_only(spark):
    made = []

    def step():
        made.append(scratch.written(spark.range(5), "inner"))
        return made[0].filter("id > 1")

    result = scratch.settled(step, "outer")
    assert result.count() == 3
    assert not os.path.exists(made[0]._scratch_path.removeprefix("file:"))
    scratch.discard(result)
