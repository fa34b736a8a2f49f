from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linewright.operators import aggregates, joins, ordering
from linewright.plans import sizing


def test_specs_expand(spark, monkeypatch):
    monkeypatch.setattr(joins, "RANGE_STEP", 7)
    specs = ["h[102-104]", "h[5-5]", "h[9-3]", "h[01-03]", "a,b,c", "a", "a,,b", "h-1", "w[1-30]", None]
    frame = spark.createDataFrame([(s,) for s in specs], "spec string")
    got: dict[str, list] = {}
    for r in joins.expand_specs(frame).orderBy("spec", "host_no").collect():
        got.setdefault(r.spec, []).append((r.host_no, r.host))
    want = {
        "h[102-104]": ["h102", "h103", "h104"],
        "h[5-5]": ["h5"],
        "h[01-03]": ["h1", "h2", "h3"],
        "a,b,c": ["a", "b", "c"],
        "a": ["a"],
        "w[1-30]": [f"w{i}" for i in range(1, 31)],
    }
    assert got == {s: list(enumerate(h)) for s, h in want.items()}


def test_specs_with_bounds_of_any_length(spark):
    nines = "9" * 36
    long = "7" * 45
    specs = {
        "h[9223372036854775808-9223372036854775809]": ["9223372036854775808", "9223372036854775809"],
        "h[9223372036854775800-9223372036854775807]": [str(9223372036854775800 + i) for i in range(8)],
        f"h[{nines}-1{'0' * 35}1]": [nines, "1" + "0" * 36, "1" + "0" * 35 + "1"],
        f"h[{long}8-{long}9]": [long + "8", long + "9"],
        f"h[{nines}{nines}-1{'0' * 72}]": [nines + nines, "1" + "0" * 72],
        "h[0-1]": ["0", "1"],
        "h[\u0661\u0662-13]": ["12", "13"],
        "h[2-1]": [],
    }
    frame = spark.createDataFrame([(s,) for s in specs], "spec string")
    got: dict[str, list] = {s: [] for s in specs}
    for r in joins.expand_specs(frame).orderBy("spec", "host_no").collect():
        got[r.spec].append(r.host[1:])
    assert got == specs
    wide = spark.createDataFrame([("h[1-99999999999999999999]",)], "spec string")
    with pytest.raises(Exception, match="range too wide"):
        joins.expand_specs(wide).count()


def test_specs_and_rows_share_names(spark):
    specs = spark.createDataFrame([(1, "h[1-2]")], "id int, spec string")
    rows = spark.createDataFrame([(7, "h1", "h1"), (8, "h2", "h2")], "id int, name string, host string")
    got = joins.spec_expand_join(specs, rows, "name")
    assert got.columns == ["id", "spec", "host_no", "host", "id_of_row", "name", "host_of_row"]
    got = joins.spec_expand_join(specs, rows.drop("name"), "host")
    assert got.columns == ["id", "spec", "host_no", "host", "id_of_row"]
    assert {(r.host, r.id_of_row) for r in got.collect()} == {("h1", 7), ("h2", 8)}


def test_specs_meet_small_and_large_tables(spark):
    specs = spark.createDataFrame([("h[1-3]",), ("h2,x",)], "spec string")
    rows = [("h1", 0), ("h9", 0)] + [("h2", i) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, v int")
    small = joins.spec_expand_join(specs, F.broadcast(df), "name")
    large = joins.spec_expand_join(specs, df.hint("merge"), "name")
    assert small.columns == large.columns == ["spec", "host_no", "host", "name", "v"]
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.count() == 41


def test_fan_out_of_any_length(spark):
    frame = spark.createDataFrame([(1,), (2,)], "x int")
    rows = joins.fan_out(frame, ["a", "b"]).collect()
    assert {(r.x, r.target_no, r.target) for r in rows} == {
        (1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"),
    }
    assert joins.fan_out(frame, []).count() == 0
    assert joins.fan_out(frame, [f"n{i}" for i in range(10_500)]).count() == 21_000


ALIASES = [
    (0, "common", "all", "c", "-c"),
    (1, "hdfs", "all", "h", "-h"),
    (2, "local", "all", "l", "-l"),
    (3, "hdfs", "hl", "h", ""),
    (4, "local", "hl", "l", "-l"),
    (5, "local", "loc", "l", "-l"),
    (6, "hdfs", "h", "first", "-1"),
    (7, "hdfs", "h", "second", "-2"),
]


@pytest.mark.parametrize(
    "hdfs,want",
    [
        (True, {"all": "c -c x", "hl": "h x", "loc": "l -l x", "h": "second -2 x", "none": "none x"}),
        (False, {"all": "c -c x", "hl": "l -l x", "loc": "l -l x", "h": "h x", "none": "none x"}),
    ],
)
def test_alias_precedence(spark, hdfs, want):
    aliases = spark.createDataFrame(ALIASES, "no int, scope string, name string, verb string, option string")
    commands = spark.createDataFrame([(k, [k, "x"]) for k in want], "k string, cmd array<string>")
    done = joins.apply_aliases(commands, "cmd", aliases, F.lit(hdfs)).collect()
    assert {r.k: " ".join(r.cmd) for r in done} == want


def test_alias_of_empty_command(spark):
    aliases = spark.createDataFrame(ALIASES, "no int, scope string, name string, verb string, option string")
    commands = spark.createDataFrame([([],)], "cmd array<string>")
    assert joins.apply_aliases(commands, "cmd", aliases, F.lit(True)).first().cmd == []


def test_upsert_blocks(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, v string")
    updates = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (3, "w")], "k int, v string")
    once = joins.keyed_upsert(target, updates, ["k"])
    want = {(1, "x"), (1, "y"), (1, "z"), (3, "w"), (2, "c"), (None, "n")}
    assert {tuple(r) for r in once.collect()} == want
    twice = joins.keyed_upsert(once, updates, ["k"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_upsert_of_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "old")], "k int, v string")
    updates = spark.createDataFrame([(None, "new")], "k int, v string")
    once = joins.keyed_upsert(target, updates, ["k"])
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (None, "new")}
    assert joins.keyed_upsert(once, updates, ["k"]).count() == 2


def test_sync_keeps_repeated_keys(spark):
    src = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    dst = spark.createDataFrame([(1, "b")], "k int, v string")
    got = {(r.src.v, r.status) for r in joins.sync_delta(src, dst, ["k"]).collect()}
    assert got == {("a", "changed"), ("b", "same")}


def test_completion_does_not_hang_on_partitions(spark):
    corpus = spark.createDataFrame([(f"ab{i}", 0) for i in range(9)], "line string, place int")
    asked = spark.createDataFrame([("ab",)], "query string")
    for n in (1, 2, 5):
        got = joins.prefix_complete(asked, corpus.repartition(n, "line"), 2, order=["place"])
        assert [r.line for r in got.orderBy("rank").collect()] == ["ab0", "ab1"]


def test_sync_statuses(spark):
    src = spark.createDataFrame(
        [(1, "new"), (2, "b"), (3, "c"), (5, "v"), (6, None), (None, "k")], "k int, v string"
    )
    dst = spark.createDataFrame(
        [(2, "old"), (3, "c"), (4, "t"), (5, None), (6, None), (None, "k")], "k int, v string"
    )
    delta = joins.sync_delta(src, dst, ["k"])
    assert {r.k: r.status for r in delta.collect()} == {
        1: "added", 2: "changed", 3: "same", 4: "target_only", 5: "changed", 6: "same", None: "same",
    }
    after = joins.apply_delta(delta, ["k"], ["v"])
    again = joins.sync_delta(src, after, ["k"])
    assert {r.status for r in again.collect()} == {"same", "target_only"}


HISTORY = ["ls", "ls -l", "ls", "", "mkdir", "été", "éta", "l", None, "Ls"]


@pytest.mark.parametrize("bound", [sizing.BROADCAST_ROWS, 0])
def test_completion(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: sizing.fits_broadcast(df, bound))
    corpus = spark.createDataFrame([(x,) for x in HISTORY], "line string")
    asked = ["l", "ls", "ls ", "é", "", "zz", "mkdir", None]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    for k in (2, 5):
        got: dict[str, list] = {}
        for r in joins.prefix_complete(queries, corpus, k).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.line)
        want = {}
        for q in asked:
            hits = sorted(x for x in HISTORY if q and x and x.startswith(q))[:k]
            if hits:
                want[q] = hits
        assert got == want


def test_completion_in_source_order(spark):
    corpus = spark.createDataFrame([(i, x) for i, x in enumerate(HISTORY)], "i int, line string")
    queries = spark.createDataFrame([("l",), ("",)], "query string")
    found = joins.prefix_complete(queries, corpus, 4, order=["i"], empty_asks_all=True)
    got: dict[str, list] = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.line)
    assert got == {"l": ["ls", "ls -l", "ls", "l"], "": ["ls", "ls -l", "ls", ""]}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_join_beyond_the_broadcast_bound(spark, how, null_safe):
    """A hot key, a hot NULL, keys on one side only; with and without the hot split."""
    rows = [(1, i) for i in range(40)] + [(None, 100 + i) for i in range(30)]
    left = spark.createDataFrame([*rows, (2, 200), (3, 300)], "a int, x int")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none"), (9, "no")], "b int, v string")

    def run(**bounds):
        df = sizing.sized_join(left, right, {"a": "b"}, how, null_safe, **bounds)
        return sorted(map(str, df.collect()))

    small = run()
    assert len(small) > 0
    assert run(max_rows=0) == small
    assert run(max_rows=0, hot_rows=10) == small
    assert run(max_rows=2, hot_rows=10, write_first=True) == small


@pytest.mark.parametrize("bound", [10, 0])
def test_membership_with_and_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(sizing, "fits_broadcast", lambda df, rows=0: bound > 0)
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a int")
    members = spark.createDataFrame([(1,), (1,), (3,), (None,)], "b int")
    kept = joins.member_filter(left, members, {"a": "b"}).collect()
    lost = joins.member_filter(left, members, {"a": "b"}, negate=True).collect()
    assert [r.a for r in kept] == [1, 1]
    assert {r.a for r in lost} == {2, None}


def test_merge_last_wins(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, v string")
    b = spark.createDataFrame([("y", "2"), ("z", "2")], "k string, v string")
    c = spark.createDataFrame([("z", None)], "k string, v string")
    got = {r.k: r.v for r in aggregates.merge_last_wins([a, b, c], ["k"], "v").collect()}
    assert got == {"x": "1", "y": "2", "z": None}


def test_exists_and_any(spark):
    frame = spark.createDataFrame([("a", "mysql-1"), ("a", None), ("b", "x"), ("c", None)], "g string, text string")
    got = {r.g: r.found for r in aggregates.exists_matching(frame, ["g"], "mysql|mariadb").collect()}
    assert got == {"a": True, "b": False, "c": False}
    assert aggregates.any_matching(frame, "mysql|mariadb")
    assert not aggregates.any_matching(frame, "oracle")


def test_concat_parts_make_the_whole(spark):
    rows = [("g", i, f"h{i}") for i in range(50)] + [("s", 1, "only"), (None, 2, "n2"), (None, 1, "n1")]
    frame = spark.createDataFrame(rows, "g string, o int, v string")
    for limit in (1000, 10):
        parts = aggregates.ordered_concat_parts(frame, ["g"], "v", ["o"], part_size=8, max_rows=limit)
        got: dict = {}
        for r in parts.orderBy("g", "part").collect():
            got.setdefault(r.g, []).append(r.text)
        assert {g: ",".join(x) for g, x in got.items()} == {
            "g": ",".join(f"h{i}" for i in range(50)), "s": "only", None: "n1,n2",
        }
        assert len(got["g"]) == 7


def test_order_of_lines(spark):
    words = ["b", "a", "Z", "é", "a", "", None, "aa"]
    frame = spark.createDataFrame(list(enumerate(words)), "i int, line string")
    want = [(None, 6), ("", 5), ("Z", 2), ("a", 1), ("a", 4), ("aa", 7), ("b", 0), ("é", 3)]
    ranked = ordering.sort_lines(frame, ties=["i"], rank="r").orderBy("r").collect()
    assert [(r.line, r.i) for r in ranked] == want
    assert [r.r for r in ranked] == list(range(1, 9))
    assert [(r.line, r.i) for r in ordering.sort_lines(frame, ties=["i"]).collect()] == want


def test_kth_and_tails(spark, monkeypatch):
    rows = [(g, i, f"{'hit' if i % 3 else 'x'}{i}") for g in ("a", "b") for i in range(20)]
    frame = spark.createDataFrame([*rows, ("c", 1, "x")], "g string, i int, line string")
    for early in (1000, 0):
        monkeypatch.setattr(ordering, "early_cut", lambda df: early)
        got = ordering.kth_match(frame, ["g"], ["i"], "hit", 4, literal=True).collect()
        assert {(r.g, r.line) for r in got} == {("a", "hit7"), ("b", "hit7")}
        assert ordering.kth_match(frame, ["g"], ["i"], "hit", 99).count() == 0
        for end, want in (("head", [0, 1, 2]), ("tail", [19, 18, 17])):
            top = ordering.head_tail(frame, ["g"], ["i"], 3, end)
            got = {}
            for r in top.orderBy("rank").collect():
                got.setdefault(r.g, []).append(r.i)
            assert got == {"a": want, "b": want, "c": [1]}
        only = frame.filter("g = 'a'")
        got = ordering.head_tail(only, [], ["i"], 2, "tail").orderBy("rank").collect()
        assert [(r.i, r.rank) for r in got] == [(19, 1), (18, 2)]
        got = ordering.head_tail(only, [], ["i"], 2).orderBy("rank").collect()
        assert [(r.i, r.rank) for r in got] == [(0, 1), (1, 2)]
