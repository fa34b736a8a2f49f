"""Line edits in both layouts against plain loops and hand-written results."""

from __future__ import annotations

import random

import pytest

from helpers import LINE_ROWS, as_docs, packed_docs, positions, row_docs
from linewright.operators import line_edits, line_rows

DOC = ["doc_id"]

ENV = [
    "",
    "unset X",
    "",
    "",
    "# A_HOME",
    "export A_HOME=/opt/a",
    "export PATH=$PATH:$A_HOME/bin",
    "",
    "",
    "",
    "#A_HOME",
    "# A_HOMEX",
    "export P=$A_HOME2",
    "# B_HOME",
    "",
]


def random_docs(seed: int, n: int, words: list, longest: int = 14) -> dict[int, list]:
    rng = random.Random(seed)
    return {
        d: [rng.choice(words) for _ in range(rng.randint(1, longest))] for d in range(n)
    }


def test_collapse_blanks_in_both_layouts(spark):
    docs = random_docs(1, 150, ["", "", "a", "b"])
    want = {}
    for d, lines in docs.items():
        kept: list[str] = []
        for x in lines:
            if not (x == "" and kept and kept[-1] == ""):
                kept.append(x)
        want[d] = kept
    once = line_edits.collapse_repeats(packed_docs(spark, docs))
    assert as_docs(once) == want
    assert as_docs(line_edits.collapse_repeats(once)) == want
    rows = row_docs(spark, docs)
    assert as_docs(line_rows.collapse_repeats(rows, DOC)) == want
    assert as_docs(line_rows.collapse_repeats(rows, DOC, chunk=3)) == want


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_renumber_over_gaps_and_empty_chunks(spark, chunk):
    rng = random.Random(8)
    rows = [(d, p, f"{d}.{p}") for d in range(30) for p in rng.sample(range(60), rng.randint(1, 25))]
    frame = spark.createDataFrame(rows, LINE_ROWS)
    got = {(r.doc_id, r.pos, r.line) for r in line_rows.renumbered(frame, DOC, chunk).collect()}
    want = set()
    for d in range(30):
        lines = sorted(p for doc, p, _ in rows if doc == d)
        want |= {(d, i, f"{d}.{p}") for i, p in enumerate(lines)}
    assert got == want


def test_null_lines_are_kept(spark):
    docs = {1: [None, None, "", "", None, ""]}
    want = {1: [None, None, "", None, ""]}
    assert as_docs(line_edits.collapse_repeats(packed_docs(spark, docs))) == want
    for chunk in (1, 2, 100):
        assert as_docs(line_rows.collapse_repeats(row_docs(spark, docs), DOC, chunk=chunk)) == want


@pytest.mark.parametrize("before,after", [(2, 1), (0, 0), (1, 3), (50, 0)])
def test_context_of_hits(spark, before, after):
    docs = random_docs(2, 80, ["x", "y", "zHITz", "w"], 20)
    want = {}
    for d, lines in docs.items():
        hits = [i for i, x in enumerate(lines) if "HIT" in x]
        near = [i for i in range(len(lines)) if any(i - after <= h <= i + before for h in hits)]
        if near:
            want[d] = near
    packed = line_edits.grep_context(packed_docs(spark, docs), "hit", before, after, ignore_case=True)
    rows = line_rows.grep_context(row_docs(spark, docs), DOC, "HIT", before, after, literal=True)
    small = line_rows.grep_context(
        row_docs(spark, docs), DOC, "HIT", before, after, literal=True, chunk=3
    )
    assert positions(packed) == want
    assert positions(rows) == want
    assert positions(small) == want
    for r in packed.union(rows.select(packed.columns)).collect():
        assert r.line == docs[r.doc_id][r.pos]
        assert r.is_hit == ("HIT" in r.line)


MARKED = {
    1: ["a", "<S>", "b", "c", "<E>", "d"],
    2: ["a", "<S>", "b"],
    3: ["a", "<E>", "b"],
    4: ["a", "b"],
    5: ["<E>", "x", "<S>", "y"],
    6: ["<S>", "1", "<S>", "2", "<E>", "3", "<S>", "4", "<E>"],
    7: ["<S>", "<E>"],
    8: ["<E>", "<S>", "m", "<E>", "<E>"],
    9: ["<S><E>", "m", "<E>"],
}


def test_cut_between_markers(spark):
    want = {
        1: ["a", "<S>", "new", "<E>", "d"],
        2: MARKED[2],
        3: MARKED[3],
        4: MARKED[4],
        5: MARKED[5],
        6: ["<S>", "1", "<S>", "new", "<E>", "3", "<S>", "4", "<E>"],
        7: ["<S>", "new", "<E>"],
        8: ["<E>", "<S>", "new", "<E>", "<E>"],
        9: ["<S><E>", "new", "<E>"],
    }
    packed = line_edits.cut_between_markers(packed_docs(spark, MARKED), "<S>", "<E>", ["new"])
    rows = line_rows.cut_between_markers(row_docs(spark, MARKED), DOC, "<S>", "<E>", ["new"])
    assert as_docs(packed) == want
    assert as_docs(rows) == want
    assert positions(rows) == {d: list(range(len(x))) for d, x in want.items()}


def test_insert_before_first_marker(spark):
    want = {}
    for d, lines in MARKED.items():
        at = next((i for i, x in enumerate(lines) if "<S>" in x), None)
        if at is None:
            want[d] = [*lines, "<S>", "u=1", "p=2"]
        else:
            want[d] = [*lines[:at], "u=1", "p=2", *lines[at:]]
    block = ["u=1", "p=2"]
    packed = line_edits.insert_before_marker(packed_docs(spark, MARKED), "<S>", block)
    rows = line_rows.insert_before_marker(row_docs(spark, MARKED), DOC, "<S>", block)
    assert as_docs(packed) == want
    assert as_docs(rows) == want
    assert positions(rows) == {d: list(range(len(x))) for d, x in want.items()}


def test_rewrite_first_and_all(spark):
    docs = {1: ["x=1", "#auth #auth", "#auth"], 2: ["none"], 3: ["#auth"], 4: []}
    frame = packed_docs(spark, docs)
    first = line_edits.rewrite_lines(frame, "#auth", "auth")
    assert as_docs(first) == {1: ["x=1", "auth auth", "#auth"], 2: ["none"], 3: ["auth"], 4: []}
    every = line_edits.rewrite_lines(frame, "#auth", "auth", mode="all")
    assert as_docs(every) == {1: ["x=1", "auth auth", "auth"], 2: ["none"], 3: ["auth"], 4: []}
    whole = line_edits.rewrite_lines(frame, "x=", "x=9", whole_line=True)
    assert as_docs(whole)[1][0] == "x=9"
    rows = line_rows.rewrite_first(row_docs(spark, docs), DOC, "#auth", "auth")
    assert as_docs(rows) == {1: ["x=1", "auth auth", "#auth"], 2: ["none"], 3: ["auth"]}
    with pytest.raises(ValueError):
        line_edits.rewrite_lines(frame, "a", "b", mode="some")


def test_block_upsert(spark):
    docs = {1: ENV, 2: ["# A_HOME"], 3: ["", ""], 4: ["last"]}
    block = line_edits.env_block("A_HOME", "/opt/new", "sbin")
    want = {
        1: ["", "unset X", "", "#A_HOME", "# A_HOMEX", "# B_HOME", "", *block],
        2: block,
        3: ["", *block],
        4: ["last", "", *block],
    }
    packed = line_edits.block_upsert(packed_docs(spark, docs), "a_home", block)
    assert as_docs(packed) == want
    assert as_docs(line_edits.block_upsert(packed, "A_HOME", block)) == want
    rows = line_rows.block_upsert(row_docs(spark, docs), DOC, "a_home", block)
    assert as_docs(rows) == want
    split = line_rows.block_upsert(row_docs(spark, docs), DOC, "a_home", block, chunk=3)
    assert as_docs(split) == want
    assert positions(split) == {d: list(range(len(x))) for d, x in want.items()}


def test_block_upsert_broad_and_bad_name(spark):
    broad = line_edits.block_upsert(packed_docs(spark, {1: ENV}), "A_HOME", ["z"], broad=True)
    assert as_docs(broad) == {1: ["", "unset X", "", "# B_HOME", "", "z"]}
    with pytest.raises(ValueError):
        line_edits.block_upsert(packed_docs(spark, {1: ENV}), "1X", ["z"])


def test_heads_and_tails(spark):
    docs = random_docs(3, 40, ["a", "b"], 6)
    frame = packed_docs(spark, docs)
    assert as_docs(line_edits.head_lines(frame, 3)) == {d: x[:3] for d, x in docs.items()}
    tails = line_edits.tail_lines(frame, 3)
    assert as_docs(tails) == {d: x[-3:] for d, x in docs.items()}
    assert positions(tails) == {
        d: list(range(max(len(x) - 3, 0), len(x))) for d, x in docs.items()
    }
