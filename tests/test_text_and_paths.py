from __future__ import annotations

import posixpath
import random
import re

from pyspark.sql import functions as F

from linewright.functions import paths
from linewright.functions.text import home_variable, line_test, split_lines
from linewright.operators import filters


def test_split_lines_like_a_text_file(spark, tmp_path):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb\r\n", "a\rb", "a\n\r\nb", "é\nß"]
    want = []
    for t in texts:
        path = tmp_path / "t"
        path.write_bytes(t.encode())
        with open(path, encoding="utf-8") as f:
            want.append([x.rstrip("\n") for x in f.readlines()])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in frame.select("i", split_lines(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == want


def test_paths_like_posix(spark):
    rng = random.Random(5)
    pieces = ["a", "b.c", "..", ".", "", "//", "/", "x y"]
    cases = [("/w/d", p) for p in ["a/b", "../x", "../../..", "/abs//y/", ".", "", "//n/s", "///n"]]
    for _ in range(400):
        path = "/".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
        cases.append((rng.choice(["/", "/w", "/w/d/", "rel", "rel/.."]), path))
    frame = spark.createDataFrame(cases, "cwd string, path string")
    for r in filters.path_profile(frame, "path", F.col("cwd")).collect():
        full = posixpath.normpath(posixpath.join(r.cwd, r.path))
        assert r.abs_path == full, (r.cwd, r.path)
        assert r.base == posixpath.basename(full)
        assert r.parent == posixpath.dirname(full)


def test_hdfs_uris_stay(spark):
    frame = spark.createDataFrame([("/w", "hdfs://n/p/../q"), ("/w", "http://n/p")], "cwd string, path string")
    got = {r.path: r.abs_path for r in filters.path_profile(frame, "path", F.col("cwd")).collect()}
    assert got == {"hdfs://n/p/../q": "hdfs://n/p/../q", "http://n/p": "/w/http:/n/p"}


def test_leaf_names(spark):
    frame = spark.createDataFrame([(p,) for p in ("/", "", "/a/b", "/a/b/", "c")], "p string")
    got = {r.p: r.x for r in frame.select("p", paths.leaf_name(F.col("p")).alias("x")).collect()}
    assert got == {"/": "/", "": "/", "/a/b": "b", "/a/b/": "b", "c": "c"}


def test_commands(spark):
    texts = ["ls -R /a", "  rm   -f  x ", "mkdir a", "", "   ", "a b\tc  -d", "a　-b\x1cd​e"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in filters.token_columns(frame, "t").collect():
        cut = [x for x in re.split(r"\s+", r.t) if x != ""]
        assert r.n_tokens == len(cut)
        assert r.n_plain == len([x for x in cut if not x.startswith("-")])
        assert r.verb == (cut[0] if cut else None)


def test_ensure_element_inserts_once(spark):
    frame = spark.createDataFrame(
        [(0, ["mkdir", "a"]), (1, ["mkdir", "-p", "a"]), (2, []), (3, ["mkdir"])],
        "i int, c array<string>",
    )
    grown = filters.ensure_element(frame, "c", F.lit("-p"))
    want = [["mkdir", "-p", "a"], ["mkdir", "-p", "a"], ["-p"], ["mkdir", "-p"]]
    assert [r.c for r in grown.orderBy("i").collect()] == want
    again = filters.ensure_element(grown, "c", F.lit("-p"))
    assert [r.c for r in again.orderBy("i").collect()] == want


def test_grep_forms(spark):
    lines = ["Jps", "node1: Kafka", "NODE2: x", "a.b", "axb", "\\E[x]", None]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")

    def found(**kw):
        return {r.line for r in filters.grep_lines(frame, **kw).collect()}

    assert found(pattern="a.b") == {"a.b", "axb"}
    assert found(pattern="a.b", literal=True) == {"a.b"}
    assert found(pattern="A.B", literal=True, ignore_case=True) == {"a.b"}
    assert found(pattern="\\e[", literal=True, ignore_case=True) == {"\\E[x]"}
    assert found(pattern=r"^node\d", ignore_case=True) == {"node1: Kafka", "NODE2: x"}
    assert found(pattern="Jps", literal=True, invert=True) == set(lines) - {"Jps"}


def test_routes_are_whole_and_apart(spark):
    specs = ["h[102-104]", "a,b,c", "a", "a,,b", "h-1", "h[1-2]\n", None]
    frame = spark.createDataFrame([(s,) for s in specs], "spec string")
    pattern = f"{filters.SPEC_LIST}|{filters.SPEC_RANGE}"
    good, bad = filters.route(frame, "spec", pattern)
    assert {r.spec for r in good.collect()} == {"h[102-104]", "a,b,c", "a"}
    assert {r.spec for r in bad.collect()} == {"a,,b", "h-1", "h[1-2]\n", None}


def test_alias_grammar(spark):
    frame = spark.createDataFrame(
        [("ll=ls -l -h",), ("x = rm -c",), ("y=cat",), ("z=ls -h -R -t",), ("bad",), ("a=b c",)],
        "line string",
    )
    got = {(r.name, r.verb, r.scope, r.option) for r in filters.parse_aliases(frame, "line").collect()}
    assert got == {
        ("ll", "ls", "local", "-h"),
        ("x", "rm", "common", ""),
        ("y", "cat", "hdfs", ""),
        ("z", "ls", "hdfs", "-t"),
    }


def test_truncate_counts_characters(spark):
    frame = spark.createDataFrame([("ééé",), ("éé",), ("",)], "t string")
    got = {(r.t, r.cut) for r in filters.truncate_text(frame, "t", 2).collect()}
    assert got == {("éé", True), ("éé", False), ("", False)}


def test_null_matches_nothing(spark):
    frame = spark.createDataFrame([(None,)], "x string")
    assert frame.select(line_test("a")(F.col("x")).alias("v")).first().v is False


def test_server_lines_and_variables(spark):
    frame = spark.createDataFrame([("node102",), ("n-7",), ("a1b2",)], "h string")
    got = {r.h: r.server for r in filters.server_lines(frame, "h").collect()}
    assert got == {
        "node102": "server.102=node102:2888:3888", "n-7": None, "a1b2": "server.1=a1b2:2888:3888",
    }
    names = spark.createDataFrame([("java",), ("zk_home",)], "n string")
    assert [r[0] for r in names.select(home_variable(F.col("n"))).collect()] == ["JAVA_HOME", "ZK_HOME"]
