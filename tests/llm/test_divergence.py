"""Divergence of sources against a plain loop over all terms."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from linewright.llm import divergence


def brute(rows, least, top=50):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), {}
        for (_, its, source), terms in zip(rows, found):
            if its == lang:
                docs.update(set(terms))
                counts.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in docs.items() if n >= least]
        counts[None] = sum(counts.values(), Counter())

        def profile(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {source: profile(c) for source, c in counts.items()}
        for a in counts:
            if a is None:
                continue
            pairs = [(b, sum(abs(p[a][t] - p[b][t]) for t in kept)) for b in counts if b not in (a, None)]
            terms = [(t, p[a][t] - p[None][t]) for t in kept if counts[a][t] and p[a][t] > p[None][t]]
            for part, found_here in (("pair", pairs), ("term", terms)):
                ordered = sorted(found_here, key=lambda x: (-x[1], x[0].encode()))
                if part == "term":
                    ordered = ordered[:top]
                out += [(lang, a, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def made(rng, n, sources, words):
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        own = [f"{source}x", "É", "the", "THE"]
        text = " ".join(rng.choice(own if rng.random() < 0.2 else words) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    return rows


def audited(spark, rows, least, **more):
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = divergence.audit(frame, least, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


WORDS = ["ant", "bee", "Cat", "dog's", "e-mail", "a1b", "ünder", "漢字", "x_y", "\x85q", "zz"] * 3 + [
    a + b for a in "abcdefgh" for b in "abcdefgh"
]


@pytest.mark.parametrize("peers,cell_rows", [(512, 1_000_000), (3, 50)])
def test_same_as_a_loop(spark, monkeypatch, peers, cell_rows):
    monkeypatch.setattr(divergence, "PEERS", peers)
    monkeypatch.setattr(divergence, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(divergence, "TERM_CELLS", 4)
    monkeypatch.setattr(divergence, "HELD", 100)
    monkeypatch.setattr(divergence, "PART", 20)
    rows = made(random.Random(peers), 260, [*"abcdefgh", None, "", "ß"], WORDS)
    got = audited(spark, rows, 5, top=7)
    assert got == brute(rows, 5, 7)
    assert {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("peers", [512, 3])
def test_rows_of_a_cell_in_any_order(spark, monkeypatch, peers):
    """Between executors a shuffle may bring postings before the rows that name groups."""
    real = divergence._accumulated
    monkeypatch.setattr(divergence, "PEERS", peers)
    monkeypatch.setattr(divergence, "TERM_CELLS", 4)
    monkeypatch.setattr(divergence, "_accumulated", lambda cell: real(cell.take(list(range(len(cell)))[::-1])))
    rows = made(random.Random(7), 150, [*"abcde", None], WORDS)
    assert audited(spark, rows, 3) == brute(rows, 3)


def test_ties_and_groups_without_terms(spark):
    rows = [("same words here", "en", s) for s in "abc"] * 2 + [("rare", "en", "d"), (None, "en", "e"), ("", "xx", "a"), ("q", "xx", "b")]
    got = audited(spark, rows, 2)
    assert got == brute(rows, 2)
    assert [r for r in got if r[:3] == ("xx", "a", "pair")] == [("xx", "a", "pair", "b", 0, 1)]


def test_sums_to_a_zero():
    rng = np.random.default_rng(1)
    values, zeros = rng.integers(0, 10**9, 300), rng.integers(0, 10**9, 40)
    want = np.abs(values[:, None] - zeros[None, :]).sum(axis=0)
    assert divergence._to_zero(values, zeros).tolist() == want.tolist()
    assert divergence._to_zero(values[:0], zeros).tolist() == [0] * 40


def test_counts_beyond_a_long(spark):
    """SCALE times a count of a large corpus does not fit 64 bits."""
    frame = spark.createDataFrame([(5 * 10**11, 9 * 10**13, 10**6)], "n bigint, total bigint, terms bigint")
    got = frame.select(divergence._share("n", "total", "terms")).first()[0]
    assert got == 1 + 10**9 * (5 * 10**11 + 5) // (9 * 10**13 + 5 * 10**6)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    got = sorted(tuple(r) for r in divergence.audit(odd, 1).collect())
    assert got == brute(rows, 1)
    assert divergence.audit(nothing).count() == 0
