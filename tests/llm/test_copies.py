"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import exact, minhash, words
from linewright.llm.components import components
from linewright.llm.queries import BINDINGS
from oracle import compare, connect

SQL = sorted(name for name, (_, sql) in BINDINGS.items() if sql)


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    query, sql = BINDINGS[name]
    rows, problems = compare(query(spark, sf_dir), connect(sf_dir), sql)
    assert rows and not problems, problems


def grams(text, width):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    width = min(width, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute_components(rows, width, percent):
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(doc, []).append(grams(text, width))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
    return {d: find(d) for d in sets}


def near_texts(rng, n):
    """Chains and clusters of texts around the threshold, some of equal sets, some very short."""
    out = []
    for _ in range(n // 12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(10):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 14))):
                text[rng.randrange(len(text))] = f"v{rng.randint(0, 50)}"
            out.append(" ".join(text))
            if rng.random() < 0.5:
                base = text
        out += [out[-1].upper(), out[-1].replace(" ", "\n\t")]
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_copies(spark, width, percent):
    rng = random.Random(width)
    rows = list(enumerate(near_texts(rng, 240)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = minhash.near_duplicates(frame, width, percent).collect()
    want = brute_components(rows, width, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(grams(t, width)) for d, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(want)


def test_links_that_a_star_misses(spark, monkeypatch):
    """With one row per band everything shares buckets, so most links are found in blocks."""
    monkeypatch.setattr(minhash, "band_rows", lambda threshold: 1)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for group in range(12):
        own = [f"g{group}x{i}" for i in range(60)]
        for i in range(4):
            text = common + own
            text[-1 - i] = f"u{group}{i}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)
    assert len(set(got.values())) == 12


def test_near_copies_of_odd_rows(spark, odd, nothing):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.n_shingles for r in by_id[2] + by_id[3] + by_id[4]] == [0, 0, 0]
    assert all(by_id[i][0].component_id == i and by_id[i][0].kept for i in (1, 2, 3, 4, 6, 7, 8))
    assert [(r.component_id, r.kept) for r in by_id[5]] == [(1, False)] * 2
    assert [(r.component_id, r.kept) for r in by_id[None]] == [(None, False)]
    assert by_id[8][0].n_shingles == 1
    assert minhash.near_duplicates(nothing).count() == 0


def test_tasks_follow_the_rows(spark, monkeypatch):
    """A small corpus is not written as a file per shuffle partition, however many these are."""
    settings = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in settings}
    files = {}

    def counted(df, label, real=minhash.written):
        table = real(df, label)
        files[label] = len(table.inputFiles())
        return table

    monkeypatch.setattr(minhash, "written", counted)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=40))) for i in range(400)]
    rows += [(400 + i, f"{text} more") for i, text in rows[:300]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    try:
        for c, value in settings.items():
            spark.conf.set(c, value)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert got == brute_components(rows, 3, 85)
    most = 2 * spark.sparkContext.defaultParallelism
    assert max(files[t] for t in ("op1-classes", "op1-buckets", "op1-texts", "op1-shares", "op1-groups")) <= most


def test_texts_under_one_id(spark):
    """Each is linked by its own text; a link of one of them is not lost."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (7, b + " more"), (9, a.upper()), (None, b), (None, "none of these words"), (3, a + " x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 2, None), (0, 58, 5), (3, 59, 3), (5, 58, 3), (5, 58, 5), (7, 59, 5), (9, 58, 3)]


def test_equal_sets_in_another_order(spark):
    """Classes are by sequence; texts with the same windows elsewhere are confirmed on their sets."""
    words = [f"w{i}" for i in range(40)]
    ring = words + words[:2]  # every rotation of the ring has the same windows
    rows = [(i, " ".join((words[i:] + words[:i] + words[i : i + 2])[:42])) for i in range(0, 38, 3)] + [(99, " ".join(ring))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (40, 0) for i, _ in rows}


def test_signature_estimates_similarity(spark):
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(3000)]
    a = rng.sample(vocabulary, 900)
    rows, want = [(0, " ".join(a))], {}
    for i, keep in enumerate((0, 300, 600, 800, 880), start=1):
        b = a[:keep] + [f"o{i}_{j}" for j in range(900 - keep)]
        rows.append((i, " ".join(b)))
        x, y = grams(rows[0][1], 1), grams(rows[i][1], 1)
        want[i] = len(x & y) / len(x | y)
    signed = minhash.signatures(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 6)
    first = signed.filter("doc_id = 0").select(F.col("planes").alias("p"))
    got = signed.filter("doc_id > 0").crossJoin(first)
    got = {r.doc_id: r.e for r in got.select("doc_id", minhash.estimate(F.col("planes"), F.col("p")).alias("e")).collect()}
    assert all(abs(got[i] - want[i]) < 0.13 for i in want)


def test_bands_miss_next_to_nothing():
    for threshold in (0.8, 0.85, 0.95):
        rows = minhash.band_rows(threshold)
        assert (1 - threshold**rows) ** (minhash.HASHES // rows) <= minhash.MISS
    assert minhash.least_estimate(0.85) < 0.7


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0b\x0c\r\x1c\x85\xa0é", max_size=30))
def test_words_are_those_of_the_pattern(text):
    want = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    assert words.words_of(text) == want
    known = np.array([hash(w) & 0xFFFF for w in want], dtype=np.uint64)
    n = len(words.window_hashes(known, 3))
    assert n == (0 if not want else max(1, len(want) - 2))


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    ring = [(i, 300 + (i - 299) % 20) for i in range(300, 320)]
    far = [(1, 900), (900, 500), (2, 500)]
    links = spark.createDataFrame(chain + star + ring + far + far, "a bigint, b bigint")
    got = {r.node: r.root for r in components(links, "test").collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 260))}
    want |= {i: 300 for i in range(300, 320)} | {1: 1, 900: 1, 500: 1, 2: 1}
    assert got == want
    assert components(links.limit(0), "test").count() == 0


def brute_exact(rows):
    groups = {}
    for doc, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(bare, []).append((doc, len(text or "")))
    out = {}
    for bare, members in groups.items():
        named = [(-n, d) for d, n in members if d is not None]
        keep = min(named)[1] if named else None
        for d, n in members:
            out[d] = (keep, len(members), d is not None and d == keep, hashlib.sha256(bare.encode()).hexdigest())
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, weak):
    rng = random.Random(4)
    bases = ["a b", "ab", "", "é x", "long text here", "\U0001f600 y", "z" * 5000]
    rows = []
    for i in range(150):
        text = rng.choice(bases)
        cut = rng.randint(0, len(text))
        rows.append((i, text[:cut] + rng.choice(["", " ", "\n\t", "\r\x0b\x0c "]) + text[cut:]))
    rows += [(150, None), (151, "\x1c"), (152, "\xa0")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    # A hash of two values only: nearly everything collides and is told apart by its bytes.
    forced = lambda t: (F.octet_length(t) % 2).cast("string").cast("binary")
    found = exact.exact_duplicates(frame, forced) if weak else exact.exact_duplicates(frame)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()}
    assert got == brute_exact(rows)


def test_exact_copies_of_odd_rows(spark, odd, nothing):
    got = exact.exact_duplicates(odd).collect()
    assert len(got) == odd.count()
    verdicts = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None)
    assert verdicts[0] == (1, 1, 3, True) and verdicts[4:6] == [(5, 1, 3, False)] * 2
    assert verdicts[1:4] == [(2, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True)]
    assert [(r.keep_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]
    assert exact.exact_duplicates(nothing).count() == 0


def test_exact_dedup_is_native(spark, documents):
    plan = exact.exact_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
