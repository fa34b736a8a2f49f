"""Language, quality, personal data, secrets and web pages against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import boosting, html_text, langid, personal, quality, secrets
from linewright.plans.scratch import written

# --- language ---------------------------------------------------------------------------


def phrases_by_search(text, reference):
    """Longest matches one after the other, by substring search."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in reference:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    samples = tuple((lang, "".join(rng.choice(letters) for _ in range(300))) for lang, letters in (("x", "abc "), ("y", "bcd ")))
    parser = langid.Parser(samples)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    got, sizes = parser.phrases(texts)
    for i, text in enumerate(texts):
        plain = "".join(map(chr, langid.letters_of(text)))
        assert sizes[i] == len(plain)
        for row, (_, sample) in enumerate(samples):
            reference = "".join(map(chr, langid.letters_of(sample)))
            assert got[row, i] == phrases_by_search(plain, reference)


def test_letters():
    assert "".join(map(chr, langid.letters_of("  Ab1, ÉÉ--ß\n漢"))) == "ab éé ß 漢"
    assert len(langid.letters_of("12 !?")) == len(langid.letters_of(None)) == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # Languages of held-out rows may not matter, nor may their texts teach anything.
    hidden = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    got = {r.doc_id: r for r in langid.identify(hidden).collect()}
    rows = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert len(rows) > 100
    import zlib

    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in (r.doc_id for r in rows))
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(odd, nothing):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3, 4, 6)} == dict.fromkeys((2, 3, 4, 6), "und")
    assert all(r.lang_pred in ("en", "de", "und") and (r.lang_pred == "und") == (r.score == 0) for r in got)
    assert langid.identify(nothing).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_rows_without_a_language_go(odd):
    kept = langid.decided(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 5, None, 7, 8}
    assert {r["_text"] for r in kept.collect()} == {"x", "z"}


# --- quality ----------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    found = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", " ", " ", "\n", "\t", "#", "&", "é", "😀", "\x85"]), max_size=60))
def test_measures(parts):
    assert quality.measure("".join(parts)) == brute_measures("".join(parts))


def test_measures_of_documents(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(documents, labels).collect()}
    for r in documents.collect():
        n, chars, symbols, lines, repeats, _ = brute_measures(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert g.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (g.kept and g.base_failed)


def test_binomial_tail_is_exact():
    for n in (1, 7, 60):
        for k in range(n + 1):
            p = Fraction(1, 3)
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(quality.at_most(k, n, 1 / 3), want, rel_tol=1e-9)


def test_cutoffs_hold_their_risk():
    rng = random.Random(2)
    good = {("x", "r"): Counter(min(300, int(rng.expovariate(0.2))) for _ in range(20_000)), ("few", "r"): Counter([0] * 50)}
    found = quality.cutoffs(good, 2)
    assert set(found) == {"x"}
    cutoff = found["x"]["r"]
    # The true share above the cutoff stays below the risk; one step tighter could not be shown.
    assert math.exp(-0.2 * (cutoff + 1)) <= quality.RISK / 2
    tighter = sum(c for s, c in good["x", "r"].items() if s > cutoff - 1)
    assert quality.at_most(tighter, 20_000, quality.RISK / 2) > 0.05 / 2 or tighter >= 20_000 * quality.RISK / 2


def test_rules_reject_what_good_documents_never_show(spark):
    clean = " ".join(f"word{i} some{i}" for i in range(40))
    junk = " ".join(f"#{i}$% &|<{i}>" for i in range(40))
    rows = [(i, clean + f" {i}", "en") for i in range(3000)] + [(9000, junk, "en"), (9001, junk, None), (9002, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(9000, 0), (None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert not got[9000].kept and "symbols" in got[9000].failed_rules
    assert got[9001].kept  # no good document of its stratum shows anything
    assert got[9002].base_failed and not got[9002].kept
    assert sum(got[i].kept for i in range(3000)) == 3000


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4, 6, 8))
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(odd, labels.limit(0)).count() == odd.count()


# --- personal data ------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_personal(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(only(m[0])) <= 19 and passes_luhn(only(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only(m[0])) <= 15]
    return out


PIECES = [
    "a", "b.c", "@", "@", ".", " ", "-", "_", "+", "+1", "(", ")", "1", "12", "255", "256", "007", "4111111111111111",
    "4111 1111 1111 1111", "10.0.0.1", "a@b.c", "x.y%z@h-1.example.org", "+1 (269) 555-3296", "555-01-02", "😀", "é", "\n",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["9" * 3000, "1." * 3000, "1 " * 3000, "a" * 100_000, "a@" * 3000, "+" + "1-" * 3000, "a.b@c" + ".d" * 3000, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: r["_base"] for r in personal.with_spans(frame).select("doc_id", "_base").collect()}
    for i, text in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == brute_personal(text), text and text[:80]


def test_personal_data_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in personal.find_personal(docs).collect()}
    kinds = Counter()
    for r in docs.collect():
        base = brute_personal(r.text)
        g, n = got[r.doc_id], Counter(k for k, _, _ in base)
        kinds += n
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert g.spans.startswith(listed)
    assert min(kinds[k] for k in ("email", "ip", "card", "phone")) > 5


def test_trees_add_spans_like_those_they_know(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, f"call +1 {phone} now, order {rng.randint(10**7, 10**8)} of 2024-01-{rng.randint(10, 28)}"))
    # No plus sign, so the base has no phone here; the number itself looks like all the others.
    rows.append((5000, "call +1 (605) 555-9305 4078918989542222 at once"))
    rows.append((5001, "order 12345678 of 2024-01-11, nothing else"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    accepted = personal.fit(frame)
    assert accepted["number"]
    got = {r.doc_id: r.spans for r in personal.find_personal(frame).collect()}
    assert got[5001] == ""
    assert all(s.count("phone:") == 1 and "number" not in s for d, s in got.items() if d < 5000)


VARIANTS = [
    ("mail anna.b (at) firm-x (dot) com. Then more", ["anna.b (at) firm-x (dot) com"]),
    ("mail anna.b[at]firm[dot]co[dot]uk", ["anna.b[at]firm[dot]co[dot]uk"]),
    ("mail anna @ firm.org", ["anna @ firm.org"]),
    ("dinner @ noon. Then more", []),
    ("the number is (605) 555-9305 there", ["(605) 555-9305"]),
    ("or 605-555-9305, or 605.555.9305", ["605-555-9305", "605.555.9305"]),
    ("number 123-45-6789 of Anna", ["123-45-6789"]),
    ("phone: 6055559305", ["6055559305"]),
    ("at 6055559305 and isbn 605-555-9305", []),
    ("2024-01-11 12:30 and 12.11.2024 and 300.12.99.100", []),
    ("version 605.555.9305, 1 234 567 890 people", []),
    ("card 4111.1111.1111.1111 or 4111.1111.1111.1112", ["4111.1111.1111.1111"]),
]


def test_trees_add_variants_that_the_base_misses(spark):
    rng = random.Random(6)
    texts = []
    for i in range(1200):
        number = f"{rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}"
        card = next(c for c in iter(lambda: str(rng.randint(10**15, 10**16 - 1)), "") if passes_luhn(c))
        phone = rng.choice([f"call +1 ({number[:3]}) 555-{number[-4:]}", f"phone: +1{number.replace(' ', '')}"])
        texts.append(f"{phone} now, x{i}@host{i}.com, user@localhost, {card}; order {rng.randint(10**9, 10**10)}; 1.2.300.{i}")
    frame = spark.createDataFrame(list(enumerate(texts + [t for t, _ in VARIANTS])), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in personal.find_personal(frame).collect()}
    for i, (text, wanted) in enumerate(VARIANTS, len(texts)):
        spans = [s.split(":") for s in got[i].split(",") if s]
        assert [text[int(a) : int(b)] for k, a, b in spans if k in ("contact", "number")] == wanted, text
    added = sum(s.startswith(("contact", "number")) for i in got for s in got[i].split(","))
    assert added == sum(len(w) for _, w in VARIANTS)  # none of the 1,200 texts' other numbers


def test_boosted_trees_learn_a_rule():
    rng = random.Random(4)
    codes = list(range(64))
    yes = [rng.randint(50, 90) if c & 3 == 3 or c & 16 else 1 for c in codes]
    no = [1 if c & 3 == 3 or c & 16 else rng.randint(50, 90) for c in codes]
    scores = boosting.Trees(6).fit(codes, yes, no).score(codes)
    assert all((s > 0) == (c & 3 == 3 or c & 16 > 0) for c, s in zip(codes, scores))


def test_redacted_texts(spark):
    rows = [
        (1, "write to a.b@c.de or +1 (269) 555-3296 😀 10.0.0.1", 7, "l", "own"),
        (2, None, 3, "l", None), (3, "nothing", 99, None, "x"), (None, "a@b.cd", 0, "l", "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, lang string, _spans string")
    clean = personal.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert got[1].text == "write to <EMAIL> or <PHONE> 😀 <IP>" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars) == (None, 3)
    assert (got[3].text, got[3].n_chars, got[3]["_spans"]) == ("nothing", 7, "x")
    assert got[None].text == "<EMAIL>"


def test_running_values(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 255, 256, 257, 1000))]
    frame = spark.createDataFrame(rows, "i int, v array<bigint>")
    sums = personal._running(F.col("v"), lambda a, b: a + b)
    most = personal._running(F.col("v"), lambda a, b: F.greatest(a, b))
    for r in frame.select("v", sums.alias("s"), most.alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v) + 1)]
        assert r.m == [max([0, *r.v[:i]]) for i in range(len(r.v) + 1)]


def test_touching_spans(spark):
    rng = random.Random(10)

    def disjoint(n):
        cuts = sorted(rng.sample(range(80), 2 * n))
        return [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]

    rows = [(disjoint(rng.randint(0, 8)), disjoint(rng.randint(0, 8)) + disjoint(rng.randint(0, 3))) for _ in range(200)]
    kind = "array<struct<start:bigint,end:bigint>>"
    frame = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    for r in frame.select("a", "b", personal._touching(F.col("a"), F.col("b")).alias("t")).collect():
        assert r.t == [any(x.start < s.end and s.start < x.end for x in r.b) for s in r.a]


def test_many_matches_in_one_text(spark):
    """Eight times the matches take at most about eight times as long, and places stay right far into a text."""
    unit = "mail a@b.cd 😀 call +1 (269) 555-3296, ip 10.0.0.1 "
    rows = [(i, "call +1 (269) 555-3296 of x@localhost, order 1234567890 ") for i in range(300)]
    took = []
    for times in (2_500, 20_000):
        frame = written(spark.createDataFrame([*rows, (-1, unit * times)], "doc_id bigint, text string"), "long")
        start = time.perf_counter()
        got = {r.doc_id: r for r in personal.find_personal(frame).collect()}[-1]
        took.append(time.perf_counter() - start)
        assert (got.n_email, got.n_ip, got.n_phone) == (times, times, times)
        at = len(unit) * times
        assert got.spans.split(",")[times - 1] == f"email:{at - len(unit) + 5}:{at - len(unit) + 11}"
    assert took[1] < 8 * took[0] + 10
    clean = personal.redact(spark.createDataFrame([(1, unit * 3000)], "doc_id bigint, text string")).first()
    assert clean.text == "mail <EMAIL> 😀 call <PHONE>, ip <IP> " * 3000


def test_personal_data_of_odd_rows(odd, nothing):
    got = personal.find_personal(odd).collect()
    assert len(got) == odd.count()
    assert [r.spans for r in got if r.doc_id is None] == ["email:23:31"]
    assert {r.spans for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert personal.find_personal(nothing).count() == 0
    assert sorted(map(str, personal.redact(odd).select("_text", "kept").collect())) == sorted(map(str, odd.select("_text", "kept").collect()))


def test_personal_data_is_native(documents):
    plan = personal.find_personal(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


# --- secrets ----------------------------------------------------------------------------


def brute_secrets(text):
    low = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in low.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


SECRET_PIECES = [
    "password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL",
    "abc123", "deadbeef", "0123456789abcdef" * 2, "x", "ſecret", "toKen", "é", "😀", "\n", "changeme", "Z9+/_.=-",
]


def test_base_secrets_are_those_of_the_patterns():
    rng = random.Random(6)
    for _ in range(5000):
        text = "".join(rng.choice(SECRET_PIECES) for _ in range(rng.randint(0, 12)))
        found = secrets.spans_of(text, {})
        base = [s for s in found if s[0] != "guessed"]
        assert base == brute_secrets(text), text
        for kind, start, end in found:
            if kind == "guessed":
                assert all(e <= start or end <= s for _, s, e in base)


def brute_cost(value, ranks):
    """Cheapest spelling over every way to cut ``value``, part by part."""
    from functools import lru_cache

    low = value.lower()

    def pairs(a, b, table):
        return all(low[i : i + 2] in table for i in range(a, b - 1))

    @lru_cache(None)
    def best(i):
        if i == 0:
            return 0.0
        options = [best(i - 1) + 1.0]
        for j in range(i - 2):
            rank = ranks.get(low[j:i])
            if rank:
                capitals = sum(map(str.isupper, value[j:i]))
                options.append(best(j) + math.log10(rank + 1) + min(capitals, i - j - capitals, 4) * 0.3 + (capitals > 0) * 0.3)
            if i - j >= 3 and all(low[k : k + 2] in secrets._WALKS | secrets._ORDERED for k in range(j, i - 1)):
                options.append(best(j) + math.log10(47 * 4 * (i - j)))
            if secrets._DATE.fullmatch(value[j:i]):
                options.append(best(j) + (math.log10(130) if i - j == 4 else secrets._DAYS))
        for part in range(1, i // 2 + 1):
            whole = value[i - part : i]
            if any(part % p == 0 and whole == whole[:p] * (part // p) for p in range(1, part)):
                continue  # its stretch is one of the shorter part
            for times in range(2 if part > 1 else 3, i // part + 1):
                if value[i - times * part : i] != whole * times:
                    break
                options.append(best(i - (times - 1) * part) + math.log10(times))
        return min(options)

    return best(len(value))


def test_guess_cost_finds_the_cheapest_spelling():
    rng = random.Random(7)
    ranks = {"pass": 3, "word": 9, "password": 1, "dog": 50, "abc": 900, "tyu": 2, "efg": 4}
    parts = ["pass", "word", "Dog", "qwe", "rty", "uiop", "aaa", "x", "Z", "!", "cde", "fgh", "1999", "31", "12", "-", "0", "ab", "ba"]
    for _ in range(1500):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) * rng.choice((1, 1, 1, 2, 3))
        wanted = brute_cost(value, ranks)
        assert secrets.guess_cost(value, ranks) == pytest.approx(wanted, abs=1e-9), value
        bar = secrets.guess_cost(value, ranks, secrets.LEAST_COST)
        assert bar == pytest.approx(wanted, abs=1e-9) if wanted < secrets.LEAST_COST - 1e-9 else bar >= secrets.LEAST_COST - 1e-9, value
    assert secrets.guess_cost("password", ranks) < 1 < secrets.guess_cost("qwerty", ranks) < 4
    assert secrets.guess_cost("aaaaaaaa", {}) < 2 and secrets.guess_cost("20240131", {}) < 5
    assert secrets.guess_cost("abab" * 6, {}) < 8 < secrets.guess_cost("x9$Kq!2mPzA", {})


def test_guess_cost_of_long_values():
    rng = random.Random(3)
    bar = secrets.LEAST_COST
    assert secrets.guess_cost("a" * 20_000, {}, bar) == pytest.approx(1 + math.log10(20_000))
    period = "x9$Kq!2mPzAwV7&bN5"  # a part of 18 characters costs more than the bar, a word does not
    assert secrets.guess_cost(period * 300, {}, bar) == math.inf
    assert secrets.guess_cost("correcthorsebatterystap" * 300, {"correcthorsebatterystap": 9}, bar) == pytest.approx(1 + math.log10(300))
    start = time.perf_counter()
    assert secrets.guess_cost("".join(rng.choices("abcdefgh0123XYZ", k=2_000_000)), {}, bar) == math.inf
    late = "a" * 1_000 + "".join(rng.choices("bcdefgh0123XYZ", k=1_000_000))
    assert secrets.guess_cost(late, {}, bar) == math.inf
    assert time.perf_counter() - start < 5
    for cut in range(90, 400, 7):  # the verdict of a prefix is that of the whole
        value = ("ab" * 60 + "password" * 30 + "x1!" * 40)[:cut]
        whole = secrets._costs(value, {"password": 1}, bar)[-1]
        assert secrets.guess_cost(value, {"password": 1}, bar) == whole


def test_hard_values_in_context_are_added():
    ranks = {w: i + 1 for i, w in enumerate(secrets.PLACEHOLDERS)}
    kinds = lambda text: [k for k, _, _ in secrets.spans_of(text, ranks)]
    assert kinds("pwd: x9$Kq!2mPzA and so on") == ["guessed"]
    assert kinds("the passphrase is gH7-kk2!Qz9 here") == ["guessed"]
    assert kinds("password: changeme") == ["assign"]
    assert kinds("pwd: changeme, pwd: password, pwd: qwertyui") == []
    assert kinds("the token of the house is old and the secret is out") == []


def test_secrets_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for r in docs.collect():
        base = brute_secrets(r.text or "")
        n = Counter(k for k, _, _ in base)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == (n["assign"], n["access"], n["hex"])
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(g.spans.split(","))


def test_dictionary_counts_all_whole_texts(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    word = lambda i: "".join(letters[i // 20**k % 20] for k in range(4))
    # Each text shares a word with the next, far beyond its beginning.
    texts = ["the house " * 400 + f"{word(i // 2)} once{word(i)}" for i in range(3000)] + [None, ""]
    texts += ["one text only: hunterzwei"] * 50  # copies are not uses by different texts
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    uses = Counter(w for t in texts for w in set(re.findall("[a-z]{3,24}", t or "")))
    kinds = Counter(w for t in set(texts) for w in set(re.findall("[a-z]{3,24}", t or "")))
    total = sum(n for w, n in uses.items() if kinds[w] > 1)
    wanted = sorted((w for w, n in uses.items() if kinds[w] > 1 and n * secrets.WORDS >= total), key=lambda w: (-uses[w], w))
    ranks = secrets.common_words(frame)
    assert [w for w in ranks if w not in secrets.PLACEHOLDERS] == [w for w in wanted if w not in secrets.PLACEHOLDERS]
    assert len(wanted) == 1502 and "hunterzwei" not in ranks
    assert secrets.common_words(frame.union(frame)) == ranks  # the same at twice the size


def test_few_words_hold_the_share(spark, monkeypatch):
    monkeypatch.setattr(secrets, "WORDS", 20)
    rows = [(i, " ".join(w * 3 for w in "abcdefghijklmnopqrstuvwxyz"[: 1 + i % 26])) for i in range(260)]
    rows = [(i, f"{t} {i}") for i, t in rows]
    ranks = secrets.common_words(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [w for w in ranks if w not in secrets.PLACEHOLDERS] == [c * 3 for c in "abcdefghi"]  # 180 of 3510 uses, the next 170


def test_secrets_of_odd_rows(odd, nothing):
    assert len(secrets.find_secrets(odd).collect()) == odd.count()
    assert secrets.find_secrets(nothing).count() == 0


# --- web pages --------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> Welcome to the site of sites</header>
<nav><ul><li><a href="/a">Alpha beta</a></li><li><a href="/b">Gamma</a></li></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all before you read on.</div>
<aside class="sidebar"><p>Other things you might like to read about today, at length.</p></aside>
{body}
<div id="comments"><p>First! I disagree with everything in this article, every word.</p></div>
<form><label>Mail</label><input name="q"><button>Go</button></form>
<footer>&copy; All rights reserved by somebody or other.</footer></body></html>"""

PARAGRAPHS = ["One  long paragraph of the article &amp; its <b>bold</b> words,\n over lines.", "Short.", "A third&nbsp;one, with a <a href='#'>link</a> inside and more text."]
WANTED = ["One long paragraph of the article & its bold words, over lines.", "Short.", "A third one, with a link inside and more text."]


@pytest.mark.parametrize(
    "body",
    [
        "<article>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article>",
        "<div>" + "".join(f"<p>{p}" for p in PARAGRAPHS) + "</div>",
        "<table><tr><td><div><div>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div></div></td></tr></table>",
        "<main><ul>" + "".join(f"<li>{p}" for p in PARAGRAPHS) + "</ul><script>x</script></main>",
    ],
)
def test_article_without_what_surrounds_it(body):
    assert html_text.main_text(PAGE.format(body=body)) == "\n".join(WANTED)


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("just text &lt;here") == "just text <here"
    assert html_text.main_text("<p>open <b>tags <i>never closed") == "open tags never closed"
    assert html_text.main_text("</div></p><p>stray ends</p></article>") == "stray ends"
    assert html_text.main_text("<p>cut in a tag <a href='x") == "cut in a tag"
    assert html_text.main_text("<script>only code") == ""
    assert html_text.main_text("<p>a<br>b</p><p>&am &#233; &#x1F600;</p>") == "a b\n&am é 😀"
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert len(html_text.main_text("<p>" + "word " * 300_000 + "</p>")) == 5 * 300_000 - 1


ARTICLE = "<p>" + "Long words of an article stand here, one after the other. " * 6 + "</p>"
SAYS = " ".join((ARTICLE[3:-4]).split())


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body><article>{ARTICLE}</article></body></html>",
        f"<head><meta charset=x><title>T</title><article>{ARTICLE}</article>",
        f"<html><head><style>p{{}}</style><div>{ARTICLE}</div>",
        f"<article>{ARTICLE}</article><!-- never closed <p>no text</p>",
        f"<script>var a = '<!--';</script><article>{ARTICLE}</article>",
        f"<!-- a --><article>{ARTICLE}</article><!--> <p></p> <!-- b -- > c",
        f"<article>{ARTICLE}</article><div class=x",
        f"<article>{ARTICLE}</article><![CDATA[ no end",
        f"<body><div>{ARTICLE}</div><div class='comments'>{'<p>I think so too, and more of it. </p>' * 60}</div>",
        f"<body><div>{ARTICLE}</div><section id='comment-section'>{'<p>I think so too, and more of it. </p>' * 600}</section>",
    ],
)
def test_open_heads_comments_and_tags(page):
    assert html_text.main_text(page) == SAYS


def test_text_right_in_an_open_head():
    assert html_text.main_text("<head><title>T</title> " + SAYS) == SAYS


@pytest.mark.parametrize("bit", ["<!--", "<a ", "<![", "<?x", "</p ", "<script>", "<!-- -->", "<p>a"])
def test_time_follows_the_length(bit):
    page = f"<article>{ARTICLE}</article>" + bit * (1_000_000 // len(bit))
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 20


def test_density_falls_with_links():
    text = "word " * 40
    tree = html_text.Tree()
    tree.feed(f"<div><p>{text}</p><p>{text}</p></div><div>" + "".join(f"<p><a href='#'>{text}</a></p>" for _ in range(3)) + "</div>")
    tree.close()
    (first, last), *rest = html_text._chosen(tree)
    assert tree.tags[first] == "div" and first == 1 and not rest


def test_density_chooses_parts_on_every_page():
    words = lambda w, n=60: f"<p>{(w + ' ') * n}</p>"
    of = lambda html: set(html_text.main_text(html).split())
    articles = "".join(f"<article>{words(f'a{i}')}{words(f'b{i}', 50 + i)}</article>" for i in range(3))
    assert of(f"<body>{articles}</body>") == {f"{x}{i}" for x in "ab" for i in range(3)}
    teasers = "".join(f"<li><a href='/{i}'>teaser</a></li>" for i in range(8))
    for tag in ("main", "article", "div"):
        assert of(f"<body><{tag}><div>{words('x')}{words('y', 70)}</div><ul>{teasers}</ul></{tag}></body>") == {"x", "y"}


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='layout has-sidebar'>", "<div class='post comments-open'>", "<div class='ad-free'>", "<form action='/p.aspx'>", "<div id='widget'>"],
)
def test_wrappers_stay_and_what_is_around_goes(wrapper):
    end = "</form>" if "form" in wrapper else "</div>"
    around = "<div class='comment-list'>" + "".join("<div class='comment'><p>I disagree with every word, at length.</p></div>" for _ in range(20)) + "</div>"
    around += "<div class='ad'><p>Buy this now.</p></div><form><p>Search here</p></form>"
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    assert html_text.main_text(f"<body>{wrapper}<div>{body}</div>{around}{end}</body>") == "\n".join(WANTED)
    assert html_text.main_text(PAGE.format(body=f"{wrapper}{body}{end}")) == "\n".join(WANTED)


def test_long_advertisement_beside_a_short_article_goes():
    page = "<body><div class='ad'>" + "Buy this now. " * 20 + "</div><article><h1>Short</h1><p>one.</p></article></body>"
    assert html_text.main_text(page) == "Short\none."


def article_by_pattern(html):
    """The generated pages have one article of headings and paragraphs."""
    from html import unescape

    article = re.search("(?s)<article>(.*?)</article>", html)[1]
    blocks = (" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n".join(filter(None, blocks))


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article_by_pattern(r.html)
        assert (got[r.page_id].n_chars, got[r.page_id].url) == (len(got[r.page_id].text), r.url)


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", None), (2, "u", "", "y"), (2, "u", "<p>b", "y"), (2, "u", "<p>b", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [("1", "None", "", 0), ("2", "u", "", 0), ("2", "u", "b", 1), ("2", "u", "b", 1), ("None", "u", "a", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0
