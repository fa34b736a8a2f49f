from __future__ import annotations

import os
from datetime import timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from linewright.plans.scratch import scratch_path
from linewright.sources import lines, listing, sinks
from linewright.streaming import changes as live
from linewright.streaming import follow


def test_files_as_lines(spark, tmp_path):
    texts = {
        "a.txt": "".join(f"line {i} {'x' * (i % 40)}\n" for i in range(500)),
        "b.txt": "one\r\ntwo\n\nfour",
        "c.txt": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {}
    for name in texts:
        with open(tmp_path / name) as f:
            for i, x in enumerate(f.readlines()):
                want[name, i] = x.rstrip("\n")

    def found(df):
        return {(os.path.basename(r.path), r.pos): r.line for r in df.collect()}

    assert found(lines.read_lines(spark, str(tmp_path))) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert found(lines.scan_files(spark, str(tmp_path))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sources_keep_order_and_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (0, "x")], "n int, text string")
    b = spark.createDataFrame([(0, "x")], "n int, text string")
    both = lines.concat_sources([("a", a), ("b", b)], ["n"]).orderBy("src_no", "n").collect()
    assert [tuple(r) for r in both] == [(0, "a", 0, "x"), (0, "a", 1, "x"), (1, "b", 0, "x")]
    with pytest.raises(ValueError):
        lines.concat_sources([], ["n"])


def test_append_and_copy(spark):
    one = spark.range(3)
    src, dst = scratch_path(spark, "src"), scratch_path(spark, "dst")
    sinks.append_table(src, one)
    sinks.append_table(src, one, one)
    assert spark.read.parquet(src).count() == 9
    sinks.copy_table(spark, src, dst)
    with pytest.raises(AnalysisException):
        sinks.copy_table(spark, src, dst)
    sinks.append_table(src, one)
    sinks.copy_table(spark, src, dst, force=True)
    assert spark.read.parquet(dst).count() == 12
    text = scratch_path(spark, "json")
    sinks.copy_table(spark, src, text, dst_format="json")
    assert spark.read.json(text).count() == 12
    cwd = scratch_path(spark, "cwd")
    copied = sinks.copy_table(spark, src, cwd=cwd)
    assert copied == f"{cwd}/{os.path.basename(src)}"
    assert spark.read.parquet(copied).count() == 12


def test_rewrite_reads_its_own_table(spark):
    root = scratch_path(spark, "table")
    assert sinks.rewrite_table(spark.range(5), "rewritten", root) is None
    new = spark.table("rewritten").select((F.col("id") + 1).alias("id"))
    old = sinks.rewrite_table(new, "rewritten", root)
    assert [r.id for r in spark.table("rewritten").orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert spark.read.parquet(old).count() == 5
    spark.sql("DROP TABLE rewritten")


def test_copy_needs_a_place(spark):
    with pytest.raises(ValueError):
        sinks.copy_table(spark, "anywhere")


def test_xml_layout_and_round_trip(spark):
    rows = [
        ("a.b", "x & <y>"), ("n", "1"), ("e", "é"), ("port", "08020"), ("blanks", "  x "),
        (" ", "  "), ("empty", ""), ("null", None), ("lines", "a\n b\n"),
    ]
    path = scratch_path(spark, "xml")
    sinks.xml_export(spark.createDataFrame(rows, "name string, value string").coalesce(1), path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert text.count("<configuration>") == 1 and text.count("<property>") == 9
    assert "<name>a.b</name>" in text and "<value>x &amp; &lt;y" in text
    assert {tuple(r) for r in sinks.xml_import(spark, path).collect()} == set(rows)


def test_listing_orders(spark, tmp_path):
    for name, size, when in (("b.txt", 3, 10), ("a.txt", 9, 20), ("sub/c.txt", 5, 30)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x" * size)
        os.utime(path, (when, when))

    def names(**kw):
        found = listing.file_catalog(spark, str(tmp_path), **kw).collect()
        return [os.path.basename(r.path)[0] for r in found]

    assert names() == ["a", "b"]
    assert names(recursive=True) == ["a", "b", "c"]
    assert names(recursive=True, sort="time") == ["c", "a", "b"]
    assert names(recursive=True, sort="size") == ["a", "c", "b"]
    assert names(recursive=True, sort="size", reverse=True) == ["b", "c", "a"]
    assert listing.file_catalog(spark, str(tmp_path), names_only=True).columns == ["path"]
    found = listing.file_catalog(spark, str(tmp_path), recursive=True, folders=True, sort="size").collect()
    assert [(os.path.basename(r.path), r.length) for r in found] == [(tmp_path.name, 12), ("sub", 5)]


def test_readable_sizes(spark):
    sizes = {0: "0", 1023: "1023", 1024: "1.0 K", 1536: "1.5 K", 64 << 20: "64.0 M", 3 << 40: "3.0 T"}
    frame = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    got = {r.n: r.s for r in frame.select("n", listing.human_size(F.col("n")).alias("s")).collect()}
    assert got == sizes


def test_follow_sees_only_new_files(spark):
    inbox, out, mark = (scratch_path(spark, x) for x in ("inbox", "out", "mark"))
    for n in (4, 7):
        sinks.append_table(inbox, spark.range(n))
        stream = follow.follow_files(spark, inbox, "id bigint")
        query = follow.land(stream, out, mark)
        query.awaitTermination()
    assert spark.read.parquet(out).count() == 11


BATCHES = [
    [("u", 1, "a"), ("u", 2, "a"), ("v", 1, None), ("w", 1, "x")],
    [("u", 3, "b"), ("v", 2, None), ("v", 3, "c"), (None, 1, "n")],
    [("u", 2, "a"), (None, 2, "m")],  # u: late, compared in order of arrival
    [("u", 4, "a"), ("v", 4, None)],
    [("w", 9, "y"), ("w", 8, "x"), ("z", 1, "q")],
    [("u", 5, "c"), ("w", 10, "y")],
]


def expected(batches):
    last: dict = {}
    out = []
    for batch in batches:
        for k, t, v in sorted(batch, key=lambda r: (str(r[0]), r[1])):
            if k in last and last[k] != v:
                out.append((k, t, v, last[k]))
            last[k] = v
    return sorted(out, key=str)


def run_batches(spark, batches, schema="k string, t int, v string", **more):
    """Each batch lands in the inbox and is read by a query of its own on the same checkpoint."""
    inbox, out, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    for batch in batches:
        sinks.append_table(inbox, spark.createDataFrame(batch, schema))
        stream = follow.follow_files(spark, inbox, schema)
        live.change_stream(stream, ["k"], ["t"], "v", out, mark, **more).awaitTermination()
    return live.read_changes(spark, out)


def test_live_changes_over_batches_and_restarts(spark):
    before = {name: spark.conf.get(name, None) for name in live.SETTINGS}
    got = [(r.k, r.t, r.v, r.prev) for r in run_batches(spark, BATCHES).collect()]
    assert sorted(got, key=str) == expected(BATCHES)
    assert {name: spark.conf.get(name, None) for name in live.SETTINGS} == before


def test_a_batch_run_again_changes_nothing(spark):
    """The last batch's commit is lost, so the next start runs it again."""
    inbox, out, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    for i, batch in enumerate(BATCHES[:3]):
        sinks.append_table(inbox, spark.createDataFrame(batch, "k string, t int, v string"))
        for again in range(1 + (i == 1)):
            stream = follow.follow_files(spark, inbox, "k string, t int, v string")
            live.change_stream(stream, ["k"], ["t"], "v", out, mark).awaitTermination()
            if i == 1 and not again:
                commits = sorted(int(n) for n in os.listdir(f"{mark}/commits") if n.isdigit())
                os.remove(f"{mark}/commits/{commits[-1]}")
                crc = f"{mark}/commits/.{commits[-1]}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    got = [(r.k, r.t, r.v, r.prev) for r in live.read_changes(spark, out).collect()]
    assert sorted(got, key=str) == expected(BATCHES[:3])


def test_other_types_keep_their_values(spark):
    big = 2**60
    batches = [[(1, 1, big), (2, 1, None)], [(1, 2, big + 1), (2, 2, None), (2, 3, big)], [(1, 3, None)]]
    got = run_batches(spark, batches, "k bigint, t bigint, v bigint").collect()
    assert sorted((r.k, r.t, r.v, r.prev) for r in got if r.v) == [(1, 2, big + 1, big), (2, 3, big, None)]
    assert [(r.k, r.t, r.prev) for r in got if r.v is None] == [(1, 3, big + 1)]
    nan = float("nan")
    got = run_batches(spark, [[("a", 1, nan)], [("a", 2, nan), ("a", 3, 1.0)]], "k string, t int, v double")
    assert [r.t for r in got.collect()] == [3]


def test_idle_keys_are_forgotten(spark):
    batches = [[("a", 1, "x")], [("a", 2, "y")]]
    assert run_batches(spark, batches, idle=timedelta(milliseconds=1)).count() == 0
    assert run_batches(spark, batches, idle=timedelta(days=1)).count() == 1


def test_a_batch_touches_the_state_of_its_keys_only(spark):
    """A second batch of one key updates one row of state, however many keys there are."""
    inbox, out, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    for rows in ([(f"k{i}", 1, "x") for i in range(500)], [("k7", 2, "y")]):
        sinks.append_table(inbox, spark.createDataFrame(rows, "k string, t int, v string"))
        stream = follow.follow_files(spark, inbox, "k string, t int, v string")
        query = live.change_stream(stream, ["k"], ["t"], "v", out, mark)
        query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in state] == [1]
    assert [s["numRowsTotal"] for s in state] == [500]
