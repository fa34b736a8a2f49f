"""How far the sources of a language are apart, and which terms set a source apart.

The term profiles of the groups (language, source) are the rows of a sparse matrix, and comparing every
group with every other is a product of that matrix with its transpose. It is taken row by row,
as Gustavson does: a group scatters its terms through a term-major index into a dense accumulator
with one place per peer, so no pair of postings is ever a row. The sum for a pair that shares no
term follows from how each profile lies to the other's value for terms it does not have; a
shared term adds what it differs from that. All values are integers.

The matrix is dealt out as cells: by a hash of the term, so that frequent terms and large groups spread
over all of them, and, with very many sources, by blocks of groups and of peers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.arrow import grouped, mapped
from linewright.plans.scratch import discard, written

LEAST_DOCS = 30  # documents of the language that a kept term is in
SMOOTHING = 5  # added to every count
SCALE = 1_000_000_000
TOP = 50  # ranks of the part ``term``

HELD = 600_000  # counted terms that a task holds before it passes them on
PART = 1 << 20  # bytes of a long text that are split at once
TERM_CELLS = 32  # parts of the terms, at least
CELL_ROWS = 1_000_000  # postings in a cell, about
PEERS = 512  # groups of a language in a block, about

#: ASCII letters in lower case; other ASCII characters part terms; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, part by part; a long text is cut between terms only."""
    raw = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term in each group and its documents there.

    Each group also has a row with an empty term and no occurrences, so none gets lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in uses.items():
                terms = [b"", *n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()).dictionary_encode().take(np.zeros(len(terms), np.int64)).cast(pa.string()),
                        pa.array([source], pa.string()).dictionary_encode().take(np.zeros(len(terms), np.int64)).cast(pa.string()),
                        pa.array(terms, pa.binary()).view(pa.string()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *(d[t] for t in n)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "d"],
                )
            uses.clear()

        held = 0
        for batch in batches:
            names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for group, text in zip(names, batch.column(0)):
                if group not in uses:
                    uses[group] = Counter(), Counter()
                n, d = uses[group]
                before = len(n)
                seen: set[bytes] = set()
                for terms in term_lists(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
                held += 1 + len(n) - before
                if held > HELD:
                    yield from passed_on()
                    held = 0
        yield from passed_on()

    known = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    schema = "lang string, source string, term string, n bigint, d bigint"
    return mapped(docs.select("text", *known), run, schema)


def _share(n: Column | str, total: str, terms: str) -> Column:
    """p of a count, by exact decimals: 1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms))."""
    n = F.col(n) if isinstance(n, str) else n
    above = (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (F.col(total) + SMOOTHING * F.col(terms)).cast("decimal(20,0)")
    frame = F.when(below > 0, F.call_function("div", above, below) + 1)
    return frame.cast("bigint")


def _to_zero(values: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Sum of \\|value - zero\\| over ``values``, for each of ``zeros``."""
    values = np.sort(values)
    sums = np.concatenate([[0], np.cumsum(values)])
    below = np.searchsorted(values, zeros)
    return zeros * below - sums[below] + (sums[-1] - sums[below]) - zeros * (len(values) - below)


def _accumulated(cell: pa.Table) -> pa.Table:
    """What the terms of a cell add to the distance of each of its groups from each of its peers.

    Rows without a term name a group or peer, with its p for a count of 0; the others are postings, whose
    terms are 0. A shuffle brings the rows in any order.
    """
    lang, part = cell["lang"][0].as_py(), cell["part"][0].as_py()
    source = cell["source"].to_pylist()
    p, n_terms = cell["p"].to_numpy(), int(cell["terms"].to_numpy().max())
    is_row, is_peer = (cell[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("as_row", "as_peer"))
    term = cell["term"].combine_chunks().dictionary_encode()
    code = term.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    heads = code < 0

    def named(of: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, their p of no occurrence; of the postings, ordered by name: name, term and p."""
        at = np.flatnonzero(heads & of)
        names = [source[i] for i in at]
        place = {name: i for i, name in enumerate(names)}
        rows = np.flatnonzero(~heads & of)
        owner = np.fromiter((place[source[i]] for i in rows), np.int64, len(rows))
        order = np.argsort(owner, kind="stable")
        return names, p[at], owner[order], code[rows][order], p[rows][order]

    rows, zero_row, row_of, row_term, row_p = named(is_row)
    peers, zero_peer, peer_of, peer_term, peer_p = named(is_peer)
    row_start = np.searchsorted(row_of, np.arange(len(rows) + 1))
    peer_start = np.searchsorted(peer_of, np.arange(len(peers) + 1))
    # The term-major index of the peers.
    order = np.argsort(peer_term, kind="stable")
    index_peer, index_p = peer_of[order], peer_p[order]
    index_start = np.searchsorted(peer_term[order], np.arange(len(term.dictionary) + 1))

    total = np.zeros((len(rows), len(peers)), dtype=np.int64)
    for j in range(len(peers)):  # terms of the peers, as if no group had them
        mine = peer_p[peer_start[j] : peer_start[j + 1]]
        total[:, j] = _to_zero(mine, zero_row) - len(mine) * np.abs(zero_row - zero_peer[j])
    for i in range(len(rows)):
        own = slice(row_start[i], row_start[i + 1])
        mine, apart = row_p[own], np.abs(zero_row[i] - zero_peer)
        total[i] += _to_zero(mine, zero_peer) - len(mine) * apart
        if part == 0:
            total[i] += apart * n_terms
        # Shared terms: through the index, into the peers' places.
        start = index_start[row_term[own]]
        found = index_start[row_term[own] + 1] - start
        at = np.repeat(start - (np.cumsum(found) - found), found) + np.arange(found.sum())
        peer, theirs, ours = index_peer[at], index_p[at], np.repeat(mine, found)
        more = np.abs(ours - theirs) - np.abs(ours - zero_peer[peer]) - np.abs(theirs - zero_row[i]) + apart[peer]
        np.add.at(total[i], peer, more)
    i, j = np.nonzero((total != 0) | (part == 0))
    names = [(rows[a], peers[b], int(total[a, b])) for a, b in zip(i.tolist(), j.tolist()) if rows[a] != peers[b]]
    a, b, value = zip(*names) if names else ((), (), ())
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "source": pa.array(a, pa.string()),
            "item": pa.array(b, pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def _distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each group and each other group of its language.

    ``kept`` has (lang, source, term, p) and ``groups`` (lang, source, zero, terms, sources).
    """
    most = groups.agg(F.max("sources")).first()[0] or 0
    blocks = -(-most // PEERS)  # of the groups of a language
    cells = max(TERM_CELLS, kept.count() * blocks // CELL_ROWS)
    block = F.pmod(F.xxhash64("source"), F.lit(max(1, blocks))).cast("int")
    part = F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int")
    heads = groups.select(
        "lang", "source", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("part"),
        F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "terms",
    )
    postings = kept.select("lang", "source", part.alias("part"), "term", "p", F.lit(0).cast("bigint").alias("terms"))
    every = heads.unionByName(postings).withColumn("own", block)
    # A row of the matrix meets all blocks of peers, and a peer all blocks of rows.
    other = F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1)))
    as_row = every.withColumn("other", other)
    mine = [c for c in every.columns if c != "own"]
    same = F.col("own") == F.col("other")
    as_row_cells = as_row.select(
        *mine, F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("as_row"), same.alias("as_peer")
    )
    as_peer_cells = as_row.filter(~same).select(
        *mine, F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("as_row"), F.lit(True).alias("as_peer")
    )
    dealt = as_row_cells.unionByName(as_peer_cells) if blocks > 1 else as_row_cells
    added = grouped(
        dealt, ["lang", "part", "i", "j"], _accumulated, "lang string, source string, item string, value bigint"
    )
    return added.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Divergence of the sources of each language of ``docs`` (text, lang, source, anything else).

    Terms are runs of ASCII letters (A-Z in lower case) and characters beyond ASCII. A language
    keeps the terms that at least ``least_docs`` of its documents have. Every group (lang, source) and
    every language gives a kept term with ``count`` occurrences p = 1 + floor(SCALE * (count + 5) /
    (N + 5 * V)): N all its occurrences of kept terms, V the kept terms of the language.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``. Part ``pair``: for each
    other source of the language the sum of the differences of p over all kept terms. Part ``term``: the
    ``top`` terms that the group has and whose p is most above the language's. Larger values come
    first, then smaller items by their UTF-8.

    Null and empty texts, languages and sources are all empty strings; a language without kept terms
    has distances of 0. Each repeated row counts. Other columns, doc_id among them, are ignored; an
    empty table gives no rows.
    """
    # Tasks have counted before, so one exchange serves the counts of a group and those of a language;
    # what most of the corpus consists of, terms of one group, is as spread as the terms.
    counts = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_d": F.sum("d").over(of_term)})
    counts = counts.filter((F.col("lang_d") >= least_docs) | (F.col("term") == "")).drop("d", "lang_d")
    counts = written(counts, "op11-counts")
    kept, heads = counts.filter("term <> ''"), counts.filter("term = ''")
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = heads.select("lang", "source").join(total, ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = groups.join(heads.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")
    zero = F.coalesce(_share(F.lit(0), "total", "terms"), F.lit(0))
    groups = written(groups.withColumn("zero", zero), "op11-groups")

    of_group = groups.select("lang", "source", "total", "terms", "lang_total")
    shares = kept.join(of_group, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q")
    )
    shares = written(shares, "op11-shares")
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = _distances(shares.drop("q"), groups)
    pairs = pairs.withColumn("rank", F.row_number().over(first)).withColumn("part", F.lit("pair"))
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    result = pairs.unionByName(above.withColumn("part", F.lit("term")))
    discard(counts)
    return result.select("lang", "source", "part", "item", "value", "rank")
