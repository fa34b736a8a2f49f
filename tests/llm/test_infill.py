"""Fill-in-the-middle against a cut by regular expression."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import infill

LETTERS = ["a", "\n", "\n", "\r", "\x0b", "é", "漢", "😀", "\x8a", "<", "P", "S", "M", ">", "\x00"]
texts = st.lists(st.text(alphabet=LETTERS, max_size=40), min_size=1, max_size=12)


def by_pattern(doc_id, text, seed=7, rate=100, spm=50):
    units = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@settings(max_examples=200, deadline=None)
@given(texts)
def test_rank_and_select(parts):
    raw = np.frombuffer("".join(parts).encode(), dtype=np.uint8)
    words = np.zeros(-(-len(raw) // 8), dtype="<u8")
    words.view(np.uint8)[: len(raw)] = raw
    for mark, hit in ((infill.line_feeds, raw == 10), (infill.continuations, (raw & 0xC0) == 0x80)):
        marks = infill.Marks(words, mark)
        places = np.arange(len(raw) + 1)
        assert marks.rank(places).tolist() == [0, *np.cumsum(hit).tolist()]
        ends = np.flatnonzero(hit) + 1
        assert marks.select(np.arange(1, len(ends) + 1)).tolist() == ends.tolist()


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_are_those_of_the_pattern(parts, x, y):
    raw = [p.encode() for p in parts]
    offsets = np.cumsum([0, *map(len, raw)])
    drawn = np.array([[x, y, 0, 0]] * len(parts), dtype=np.int64)
    n, places, prefix, middle = infill._cut(np.frombuffer(b"".join(raw), np.uint8), offsets, drawn)
    for i, text in enumerate(parts):
        units = re.findall("[^\n]*\n|[^\n]+", text)
        low, high = sorted((x % (len(units) + 1), y % (len(units) + 1)))
        assert n[i] == len(units)
        assert prefix[i] == len("".join(units[:low])) and middle[i] == len("".join(units[low:high]))
        assert [p[i] - offsets[i] for p in places] == [len("".join(units[:k]).encode()) for k in (low, high)]


@pytest.mark.parametrize("rate,spm", [(100, 50), (30, 0), (70, 100)])
def test_texts_come_back(spark, documents, rate, spm, monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 5000)
    made = infill.fill_in_middle(documents, 7, rate, spm)
    made = made.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    rows = {r.doc_id: r.text for r in documents.collect()}
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_pattern(r.doc_id, rows[r.doc_id], 7, rate, spm)
        assert r.back == rows[r.doc_id]


def test_parts_that_end_like_markers(spark):
    rows = [(i, t) for i, t in enumerate(["a<\n<\nS>\n>M", "<P\n>\n<<\n", "<S\n>P>\n<M\n>", "x\n<P>\n", "\n", "<\n" * 9] * 20)]
    made = infill.fill_in_middle(frame_of(spark, rows))
    made = made.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    for r in made.collect():
        assert r.back == rows[r.doc_id][1]
        assert (r.form == "plain") == ("<P>" in r.back)


def test_odd_rows(spark, odd, nothing):
    want = sorted((r.doc_id or -1, by_pattern(r.doc_id, r.text or "")) for r in odd.collect())
    got = infill.fill_in_middle(odd).collect()
    assert sorted((r.doc_id or -1, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert infill.fill_in_middle(nothing).count() == 0
    long = frame_of(spark, [(1, "é\n" * 2_000_000), (2, "x" * 3_000_000), (3, None)])
    for r in infill.fill_in_middle(long).select("doc_id", "n", F.length("output").alias("size")).collect():
        assert (r.n, r.size) == {1: (2_000_000, 4_000_009), 2: (1, 3_000_009), 3: (0, 0)}[r.doc_id]
