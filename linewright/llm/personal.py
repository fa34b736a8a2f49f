"""Personal data: base patterns, and candidates judged by boosted trees.

Only Spark SQL functions run over the texts. Wide patterns propose spans; each gets a code of
format and context features, from which the signs that only the base's own form has are masked:
a plus, the signs between groups, how '@' and dots are written. Proposals that touch a find of
the base are positive; those off them are negative only where the base or the context can tell
(``_refused``), and the rest, variants that the base cannot read, teach nothing. Trees are fitted
on how often each code was seen with each label, over half of the documents, and a threshold per
generator is calibrated on the other half: the lowest score, of even odds or better, from which
at least PRECISION of the labelled proposals are positive, and enough of them to say with CONFIDENCE that
LEAST_PRECISION holds. Proposals above it, off the base's
finds and with a code that finds of the base have too, are added. A text never leaves its row, so
nothing is shuffled but the counts.

The patterns never try a start inside a run that already failed, and their loops give
nothing back, so a text of any length is read once. Places are running sums over what stands between
the matches, what touches the base is counted along the sorted ends of spans, and context comes
from the cell of the text that a span begins in, so no step looks at all spans, or all of the text, for each span.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.boosting import Trees
from linewright.llm.quality import at_most

LOCAL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"
#: Same matches as the contract's patterns; starts and loops are tightened as said above.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wide patterns: written-out addresses; any run of digit groups.
PROPOSED = {
    "contact": rf"(?:\G|(?<!{LOCAL})){LOCAL}++ ?(?:\(at\)|\[at\]|\{{at\}}|@) ?{HOST}++(?:(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}) ?| \. |\.){HOST}++)*+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./:-]{0,2}[0-9])++(?![0-9A-Za-z])",
}
#: A match needs one of these strings, or a digit (follows from the patterns).
MARKS = {"email": ["@"], "phone": ["+"], "contact": ["@", "(at)", "[at]", "{at}"]}
LEAST_DIGITS = 7  # of a proposed number

PRECISION = 0.98
CONFIDENCE = 0.95  # with which the precision is at least LEAST_PRECISION, however few proposals there are
LEAST_PRECISION = 0.95
CONTEXT = 24  # characters before a span that its cues are looked for in
RUN = 256  # elements of an array that are added up one by one
CELL = 64  # characters of a text that are kept together; at least CONTEXT

PLACE = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"
PROPOSAL = "array<struct<kind:string,start:bigint,end:bigint,code:int,hit:boolean,labelled:boolean>>"


def _all_matches(text: Column, kind: str, pattern: str) -> Column:
    """Most texts lack the marks and are not read by the pattern at all."""
    marks = [text.contains(mark) for mark in MARKS.get(kind, [])]
    may = reduce(lambda a, b: a | b, marks) if marks else F.col("_digit")
    none = F.array().cast("array<string>")
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(first: Column, last: Column) -> Column:
    """The ints from ``first`` to ``last``, none if that is below it. With them arrays are read place by place:
    a slice would copy the whole array first."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of bigints, ``combine`` of 0 and all those before it; at the end, of all.

    Appending copies an array, so it is done in runs of RUN elements, which are then joined up.
    """
    none = F.array().cast("array<bigint>")

    def runs(every: Column) -> Column:
        def step(seen: Column, i: Column) -> Column:
            now = combine(seen["at"], F.get(every, i))
            return F.struct(now.alias("at"), F.array_append(seen["out"], seen["at"]).alias("out"))

        def run(seen: Column, k: Column) -> Column:
            start = F.struct(seen["at"].alias("at"), none.alias("out"))
            done = F.aggregate(_numbers(k * RUN, F.least((k + 1) * RUN, F.size(every)) - 1), start, step)
            return _let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(seen["out"], d["out"]).alias("out")))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        numbers = _numbers(F.lit(0), F.ceil(F.size(every) / RUN).cast("int") - 1)
        return F.aggregate(numbers, start, run, lambda seen: F.array_append(F.flatten(seen["out"]), seen["at"]))

    return _let(values, runs)


def _placed(kind: str, matches: Column, between: Column) -> Column:
    """Where the matches lie: after what stands between them and the matches before, in code points."""

    def spans(matches: Column, between: Column) -> Column:
        steps = F.zip_with(
            F.slice(between, F.lit(1), F.size(matches)),
            matches,
            lambda gap, match: (F.char_length(gap) + F.char_length(match)).cast("bigint"),
        )

        def span(match: Column, i: Column, ends: Column) -> Column:
            end = F.get(ends, i + 1)
            start = end - F.char_length(match)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match.alias("match"))

        running = _running(steps, lambda a, b: a + b)
        return _let(running, lambda ends: F.transform(matches, lambda match, i: span(match, i, ends)))

    placed = _let(matches, lambda m: _let(between, lambda b: spans(m, b)))
    return F.when(F.size(matches) > 0, placed).otherwise(F.array().cast(PLACE))


def _touching(spans: Column, base: Column) -> Column:
    """For each of ``spans``, disjoint and in order, whether it has a character in common with one of ``base``.

    That is so when more of the base's spans begin before its end than end by its start.
    """

    def earlier(place: Callable[[Column], Column], of_base: Callable[[Column], Column], ties: bool) -> Column:
        """For each span, the spans of the base with ``of_base`` before its ``place``, or with ``ties`` at it."""
        asked, counted = (F.lit(int(ties)), F.lit(int(not ties)))

        def event(at: Column, turn: Column, is_base: int) -> Column:
            return F.struct(at.alias("at"), turn.alias("turn"), F.lit(is_base).cast("bigint").alias("n"))

        events = F.concat(
            F.transform(spans, lambda s: event(place(s), asked, 0)), F.transform(base, lambda b: event(of_base(b), counted, 1))
        )

        def at_spans(events: Column) -> Column:
            sums = _running(F.transform(events, lambda e: e["n"]), lambda a, b: a + b)
            both = _let(sums, lambda n: F.transform(events, lambda e, i: F.struct(e["n"].alias("n"), F.get(n, i).alias("before"))))
            return F.transform(F.filter(both, lambda x: x["n"] == 0), lambda x: x["before"])

        return _let(F.array_sort(events), at_spans)

    begun = earlier(lambda s: s["end"], lambda b: b["start"], False)
    ended = earlier(lambda s: s["start"], lambda b: b["end"], True)
    return F.zip_with(begun, ended, lambda a, b: a > b)


def _cells(text: Column) -> Column:
    """The text in pieces of CELL characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))


def _between(cells: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in cells; reads these only."""
    first = F.floor(start / CELL).cast("int")
    last = F.least(F.floor(end / CELL).cast("int"), F.size(cells) - 1)
    piece = F.array_join(F.transform(_numbers(first, last), lambda i: F.get(cells, i)), "")
    return F.substr(piece, (start - first * CELL + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.char_length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add)
    return F.when(F.char_length(number) > 0, total % 10 == 0).otherwise(F.lit(False))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_SHAPE = rf"^{_PART}(?:\.{_PART}){{3}}$"


def _card(span: Column) -> Column:
    number = digits(span["match"])
    return F.when(F.char_length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))


#: What a match must be, besides matching; the others always hold.
CHECKS = {
    "ip": lambda s: s["match"].rlike(IP_SHAPE),
    "card": _card,
    "phone": lambda s: F.char_length(digits(s["match"])).between(9, 15),
    "number": lambda s: F.char_length(digits(s["match"])) >= LEAST_DIGITS,
}


def _valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, CHECKS[kind]) if kind in CHECKS else spans


def _of_kind(kind: str) -> Column:
    return F.filter("_base", lambda s: s["kind"] == kind)


def _plain(contact: Column) -> Column:
    """An address with its signs as the base writes them."""
    at = F.regexp_replace(contact, r" ?(?:\(at\)|\[at\]|\{at\}|@) ?", "@")
    return F.regexp_replace(at, r" ?(?:\(dot\)|\[dot\]|\{dot\}) ?| \. ", ".")


def _before(span: Column, cells: Column) -> Column:
    start = span["start"]
    return F.lower(_between(cells, F.greatest(start - CONTEXT, F.lit(0)), start))


DATE = r"^(?:[0-9]{4}[./:-][0-9]{1,2}[./:-][0-9]{1,2}|[0-9]{1,2}[./:-][0-9]{1,2}[./:-](?:[0-9]{4}|[0-9]{1,2}))(?:[ :]|$)"
FOUR_GROUPS = r"^[0-9]+(?:\.[0-9]+){3}$"
NAMED = r"\b(?:tel|phone|call|fax|mobile|cell|e-?mail|contact|card|visa|account|ssn|ip)\b[^a-z]*$"
NAMED_OTHER = r"(?:[=#/_$]|\b(?:version|page|section|no|isbn|id|article)\b[^a-z]*)$"


def _features(span: Column, before: Column) -> list[Column]:
    match = span["match"]
    is_number = span["kind"] == "number"
    number = F.when(is_number, digits(match)).otherwise("")
    size = F.char_length(number)
    grouped = match.rlike("[0-9][^0-9]+[0-9]")
    plain = _plain(match)
    return [
        size.between(7, 8),
        size.between(9, 12),
        size.between(13, 19),
        is_number & (size < 13) & grouped,
        is_number & (size < 13) & match.rlike(r"(?<![0-9])[0-9]{4}$"),
        is_number & match.rlike(r"^[0-9]{1,3}(?:[ .][0-9]{3})+$"),
        is_number & match.rlike(r"^(?:[0-9]{4}[ ./-]?){3}[0-9]{1,7}$"),
        F.when(size.between(13, 19), luhn(number)).otherwise(F.lit(False)),
        match.rlike(IP_SHAPE),
        (size < 13) & match.rlike(FOUR_GROUPS),
        ~is_number & plain.rlike(r"@.+\."),
        ~is_number & plain.rlike(r"\.[A-Za-z]{2,12}$"),
        match.rlike(DATE),
        is_number & (size < 13) & ~grouped & before.rlike(NAMED),
        is_number & before.rlike(NAMED_OTHER),
    ]


def _refused(span: Column, before: Column) -> Column:
    """Whether a proposal off the base's finds is none: the base reads its form and found
    nothing, or it is a date, named as something else, or a bare number that nothing names."""
    match = span["match"]
    size = F.char_length(digits(match))
    return F.when(span["kind"] == "contact", match.rlike("^[^ ()\\[\\]{}]+$")).otherwise(
        match.startswith("+")
        | (size > 19)
        | (size.between(13, 19) & match.rlike("^[0-9](?:[ -]?[0-9])+$"))
        | ((size < 13) & match.rlike(FOUR_GROUPS))
        | match.rlike(DATE)
        | before.rlike(NAMED_OTHER)
        | (match.rlike("^[0-9]+$") & ~before.rlike(NAMED))
    )


N_FEATURES = 15


def _code(span: Column, before: Column) -> Column:
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(_features(span, before))]
    return reduce(lambda a, b: a + b, bits)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) plus ``_base``, an array of the base's spans by kind, then
    start, and ``_proposed``, an array of (kind, start, end, code, hit, labelled) for the trees."""
    text = F.col("_text")
    kinds = BASE | PROPOSED
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = df.withColumn("_digit", text.rlike("[0-9]"))
    df = df.withColumns({f"_m_{k}": _all_matches(text, k, p) for k, p in kinds.items()})
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {f"_b_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in kinds.items()}
    )
    df = df.withColumns({f"_s_{k}": _valid(k, _placed(k, F.col(f"_m_{k}"), F.col(f"_b_{k}"))) for k in kinds})
    df = df.withColumn("_base", F.concat(*(F.col(f"_s_{k}") for k in BASE)))

    def judged(kind: str, base: Column, cells: Column) -> Column:
        def one(span: Column, touches: Column, before: Column) -> Column:
            return F.struct(
                span["kind"].alias("kind"),
                span["start"].alias("start"),
                span["end"].alias("end"),
                _code(span, before).alias("code"),
                touches.alias("hit"),
                (touches | _refused(span, before)).alias("labelled"),
            )

        def known(span: Column, touches: Column) -> Column:
            return _let(_before(span, cells), lambda before: one(span, touches, before))

        return _let(F.col(f"_s_{kind}"), lambda spans: F.zip_with(spans, _touching(spans, base), known))

    some = reduce(lambda a, b: a | b, (F.size(f"_s_{k}") > 0 for k in PROPOSED))
    proposed = _let(
        F.col("_base"),
        lambda base: _let(_cells(text), lambda cells: F.concat(*(judged(k, base, cells) for k in PROPOSED))),
    )
    df = df.withColumn("_proposed", F.when(some, proposed).otherwise(F.array().cast(PROPOSAL)))
    return df.drop("_text", "_digit", *(f"_{x}_{k}" for x in "mbs" for k in kinds))


def fit(docs: DataFrame) -> dict[str, list[int]]:
    """Codes that the trees accept, by generator; at most 2 ** N_FEATURES of each are counted."""
    half = F.pmod(F.xxhash64("_base.start", "doc_id"), F.lit(2))
    # The outer form keeps Catalyst from inferring a filter that would search every text again.
    # The half is worked out once per text: next to the explode it would be hashed for every proposal.
    seen = with_spans(docs.select("doc_id", "text")).select(half.alias("half"), "_proposed")
    seen = seen.select("half", F.explode_outer("_proposed").alias("s")).filter("s IS NOT NULL AND s.labelled")
    counts = seen.groupBy("half", "s.kind", "s.code", "s.hit").agg(F.count(F.lit(1)).alias("n")).collect()
    accepted = {}
    for kind in PROPOSED:
        rows = [r for r in counts if r["kind"] == kind]
        codes = sorted({r["code"] for r in rows})
        place = {c: i for i, c in enumerate(codes)}
        n = np.zeros((2, 2, len(codes)))  # half, hit, code
        for r in rows:
            n[r["half"], int(r["hit"]), place[r["code"]]] += r["n"]
        accepted[kind] = []
        if not n[0].sum():
            continue
        scores = Trees(N_FEATURES).fit(codes, n[0, 1], n[0, 0]).score(codes)
        least = None
        for score in sorted(set(scores.tolist()), reverse=True):  # thresholds, falling
            chosen = scores >= score
            good, seen_here = n[1, 1, chosen].sum(), n[1][:, chosen].sum()
            if score <= 0 or good < PRECISION * seen_here:
                break
            # Exactly: so many good ones would be too many if the precision were lower.
            if at_most(int(seen_here - good), int(seen_here), 1 - LEAST_PRECISION) <= 1 - CONFIDENCE:
                least = score
        if least is not None:
            accepted[kind] = [c for c, s, known in zip(codes, scores, n[:, 1].sum(0)) if c and s >= least and known]
    return accepted


def added(accepted: dict[str, list[int]]) -> Column:
    """The proposals that the trees accept, off the base's finds, in order."""

    def chosen(span: Column) -> Column:
        good = [(span["kind"] == kind) & span["code"].isin(codes) for kind, codes in accepted.items() if codes]
        return ~span["hit"] & reduce(lambda a, b: a | b, good, F.lit(False))

    return F.filter("_proposed", chosen)


def _listed(spans: Column) -> Column:
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def find_personal(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text, anything else).

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` (lowercase hex of
    the base's kind:start:end, joined by commas) and ``spans`` (all: those the trees add follow,
    as ``contact`` and ``number``; places in code points, the end exclusive). A null text is
    empty. Null ids and repeated rows go through as they are. Other columns are ignored; an empty
    table gives no rows.
    """
    accepted = fit(docs)
    spanned = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(_of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    base = _listed(F.col("_base"))
    every = F.array_join(F.filter(F.array(base, _listed(added(accepted))), lambda x: x != ""), ",")
    return spanned.select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``find_personal`` in ``text`` replaced by its kind, as <EMAIL>.

    Overlapping spans become one, named for the first. All columns stay, ``n_chars`` follows the
    text when there is one; a null text stays null.
    """
    accepted = fit(docs)
    plain = F.transform("_base", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    more = F.transform(added(accepted), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    # Whole rows are one column, so that no name of theirs meets the ones used here.
    df = with_spans(docs.select(F.struct(*docs.columns).alias("_row"), "text"))

    def replaced(spans: Column, cells: Column, done: Column) -> Column:
        """``done``: for each span the largest end before it, and the last of all."""

        def one(span: Column, i: Column) -> Column:
            name = F.concat(_between(cells, F.get(done, i), span["start"]), F.lit("<"), F.upper(span["kind"]), F.lit(">"))
            return F.when(span["start"] >= F.get(done, i), name).otherwise("")

        rest = _between(cells, F.get(done, F.size(spans)), F.char_length("text").cast("bigint"))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    def of_spans(spans: Column) -> Column:
        ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return _let(_cells(F.col("text")), lambda cells: _let(ends, lambda done: replaced(spans, cells, done)))

    spans = F.array_sort(F.concat(plain, more))
    clean = F.when(F.size(F.concat(plain, more)) > 0, _let(spans, of_spans)).otherwise(F.col("text"))
    df = df.withColumn("_clean", clean)
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("_clean").cast("bigint"), F.col("_row.n_chars"))
    return df.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
