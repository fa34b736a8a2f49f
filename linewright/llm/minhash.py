"""Near duplicates by b-bit MinHash with exact confirmation.

Each text gets ``HASHES`` minima of its word-window hashes. Groups of minima (bands) give
candidates; of every minimum the low ``BITS`` bits are kept, packed in bit planes, so that
the similarity of two candidates is estimated by counting bits and corrected for chance
collisions. What the estimate lets through is confirmed on the full window sets.

Hot groups never meet pair by pair. Texts with equal words in equal order (by 128-bit hash) are one
class; all other links are confirmed on the sets. A text's windows that
no other candidate has bound its similarity to anything from above; texts that cannot reach
the threshold leave. In a bucket all members first meet one only, its centre: the one with the
fewest windows of its own, which most others are likest to. Buckets with one centre are one group.
Links found so far are joined into components; in each group the members outside its largest
component then meet a centre of their own, and at last those still outside meet the whole
group in blocks of bounded size, in a join that weighs bounds, bits and window sets in its
condition and only lets links out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm.arrow import mapped
from linewright.llm.components import components
from linewright.llm.words import WordHashes, mix, window_hashes, windows, words_of
from linewright.plans.scratch import discard, written

HASHES = 192  # minima per text; three longs per bit plane
BITS = 4  # low bits kept of each minimum
LONGS = HASHES // 64
MISS = 1e-6  # most probability that a link at the threshold shares no band
DEVIATIONS = 6.5  # the estimate may be this many standard deviations too low
BLOCK = 512  # members of a group per block
TASK_ROWS = 4_000  # texts of a task, about; of one that works on pairs or window sets a quarter

#: n, f1 and f2, then the bit planes and the bands.
SIGNATURE = [T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")] + [
    T.StructField(c, T.ArrayType(T.LongType())) for c in ("planes", "bands")
]


def band_rows(threshold: float) -> int:
    """Most minima per band with which a pair at the threshold is missed with at most MISS."""
    for rows in range(16, 1, -1):
        if (1 - threshold**rows) ** (HASHES // rows) <= MISS:
            return rows
    return 1


def _signer(width: int, rows: int):
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)
    n_bands = HASHES // rows
    salt = mix(np.arange(n_bands, dtype=np.uint64))

    def sign(text: str | None, hashes: WordHashes):
        words = words_of(text, fold=True)
        if not words:
            return 0, 0, 0, [], []
        known = np.fromiter((hashes[w] for w in words), dtype=np.uint64, count=len(words))
        grams = np.unique(window_hashes(known, width))
        low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(grams), 512):
            part = a[:, None] * grams[None, i : i + 512] + b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        spread = mix(low)
        planes = [
            np.packbits(((spread >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
            for j in range(BITS)
        ]
        keys = salt.copy()
        for i in range(rows):
            keys = mix(keys ^ low[i : n_bands * rows : rows])
        # No word holds a blank, so joined words are one to one with their sequence.
        f1, f2 = np.frombuffer(hashlib.md5(b" ".join(words)).digest(), dtype="<i8").tolist()
        return len(grams), f1, f2, np.concatenate(planes).tolist(), keys.view(np.int64).tolist()

    return sign


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """SIGNATURE of every row of ``docs`` after its columns other than ``text``, which comes last."""
    named = docs.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, hashes = _signer(width, rows), WordHashes()
        for batch in batches:
            signed = [sign(t.as_py(), hashes) for t in batch.column(len(named))]
            columns = list(zip(*signed)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=[*named.names, "n", "f1", "f2", "planes", "bands"],
            )

    return mapped(docs.select(*named.names, "text"), run, T.StructType([*named.fields, *SIGNATURE]))


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: equal minima by bit counts, less chance collisions."""
    unequal = None
    for i in range(LONGS):
        differs = None
        for j in range(BITS):
            x = a[j * LONGS + i].bitwiseXOR(b[j * LONGS + i])
            differs = x if differs is None else differs.bitwiseOR(x)
        count = F.bit_count(differs)
        unequal = count if unequal is None else unequal + count
    chance = 2.0**-BITS
    return ((F.lit(1.0) - unequal / F.lit(float(HASHES))) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(threshold: float) -> float:
    """What a true link's estimate stays above, but for a chance far below MISS."""
    return threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / HASHES) - 0.01


def most_similar(n_a: Column, shared_a: Column, n_b: Column, shared_b: Column) -> Column:
    """No two texts are more similar than this: they have in common at most the smaller number of
    windows that either shares with anything."""
    common = F.least(shared_a, shared_b)
    return common / (n_a + n_b - common)


def _window_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams): hashes of each text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = []
            for text in batch.column(1):
                words = words_of(text.as_py(), fold=True)
                known = np.fromiter((hashes[w] for w in words), dtype=np.uint64, count=len(words))
                sets.append(np.unique(window_hashes(known, width)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "grams"]
            )

    return mapped(texts, run, "doc_id bigint, grams array<bigint>")


def _own_windows(texts: DataFrame, width: int, tasks: int) -> DataFrame:
    """(doc_id, own): windows of each text that no other text of ``texts`` has, where there are any."""
    grams = _window_sets(texts, width).select("doc_id", F.explode("grams").alias("gram"))
    # Counting combines before the shuffle, so a window that everything has is no hot task.
    single = grams.groupBy("gram").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n")).coalesce(tasks)
    return single.filter("_n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on their full window sets."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb")), "b")
    both = both.coalesce(tasks).join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, set()
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, sets = a[i], windows(words_of(ta[i].as_py(), fold=True), width)
                other = windows(words_of(tb[i].as_py(), fold=True), width)
                same = len(sets & other)
                keep.append(100 * same >= percent * (len(sets) + len(other) - same))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = mapped(both.select("a", "b", "_ta", "_tb").coalesce(tasks), run, "a bigint, b bigint")
    return written(links, "op1-links")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, anything else): its component.

    Words are runs of characters other than space and tab to carriage return, A-Z in lower
    case. A text's set: its distinct windows of ``width`` words; with fewer words the whole
    sequence; without words nothing, and it is linked with nothing. Two texts are linked
    when 100 * intersection >= percent * union. Returns ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest doc_id reachable) and ``kept`` (doc_id = component_id).

    Rows that share a doc_id are each linked by their own text. A null text is empty. A null doc_id
    takes the smallest id of its component, or null when there is none; it is kept false.
    Other columns are ignored. An empty table gives no rows.
    """
    found = linked(docs.select("doc_id", "text"), width, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Columns of ``docs`` other than text, ``n`` (size of the set), ``root`` and ``component_id`` of each row.

    ``docs`` has doc_id, text and at most a column _number. ``root`` names the component, whether
    or not it has ids; it is null without words.
    """
    rows = band_rows(percent / 100)
    cut = least_estimate(percent / 100)
    named = [c for c in docs.columns if c != "text"]
    # The text's own hash tells rows of one id apart.
    docs = docs.withColumn("_of", F.xxhash64("text"))
    signed = written(signatures(docs.select(*named, "_of", "text"), width, rows), "op1-signatures")
    # Tasks follow the rows, not the number of shuffle partitions: most steps here have few rows, and
    # a task with next to none still opens and writes files.
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, signed.count() // TASK_ROWS)
    busy = 4 * tasks
    print_of = ["n", "f1", "f2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_of").alias("of")))
    # A class has one sequence of words, so any member's planes and bands are those of all.
    same = [F.first(c).alias(c) for c in ("planes", "bands")]
    classes = signed.filter("n > 0").groupBy(*print_of).agg(first.alias("_first"), *same)
    classes = classes.select(*print_of, F.col("_first.id").alias("_id"), F.col("_first.of").alias("_head"), "planes", "bands")
    classes = written(classes.coalesce(tasks).withColumn("rep", F.monotonically_increasing_id()), "op1-classes")
    # From here on a class, as its number, is what has a text.
    members = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = members.join(written(sizes.coalesce(tasks), "op1-sizes"), "key")
    buckets = written(buckets.coalesce(tasks), "op1-buckets")

    asked = buckets.select(F.col("doc_id").alias("rep")).distinct().coalesce(tasks).hint("merge")
    reps = classes.select("_id", "_head", "rep", "n", "planes").join(asked, "rep")
    reps = written(reps.coalesce(tasks), "op1-reps")
    # One exchange of the texts, whatever the number of candidates; later steps read these.
    is_head = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_head"))
    texts = docs.select("doc_id", "_of", "text").join(reps.select("_id", "_head", "rep").hint("merge"), is_head)
    texts = texts.select(F.col("rep").alias("doc_id"), "text").coalesce(tasks).dropDuplicates(["doc_id"])
    texts = written(texts.coalesce(tasks), "op1-texts")
    own = _own_windows(texts, width, busy)
    shares = reps.select(F.col("rep").alias("doc_id"), "n", "planes").join(own, "doc_id", "left")
    shares = shares.withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
    shares = shares.filter(100 * F.col("shared") >= percent * F.col("n"))
    shares = written(shares.select("doc_id", "n", "shared", "planes").coalesce(tasks), "op1-shares")

    def side(x: str) -> DataFrame:
        return shares.select(*(F.col(c).alias(f"{c}_{x}") for c in shares.columns))

    def likely() -> Column:
        bound = most_similar(F.col("n_a"), F.col("shared_a"), F.col("n_b"), F.col("shared_b"))
        return (100 * bound >= percent - 1e-6) & (estimate(F.col("planes_a"), F.col("planes_b")) >= cut)

    alone = (1 - F.col("shared") / F.col("n")).alias("alone")
    placed = written(buckets.join(shares.select("doc_id", alone), "doc_id").coalesce(tasks), "op1-placed")
    centres = placed.groupBy("key").agg(F.min(F.struct("alone", "doc_id")).alias("_c"))
    centres = written(centres.select("key", F.col("_c.doc_id").alias("centre")).coalesce(tasks), "op1-centres")
    # Two texts of a bucket are in the group of its centre; a text is in one group or a few.
    groups = placed.join(centres, "key").select("centre", "doc_id", "alone").coalesce(tasks).distinct()
    groups = written(groups.coalesce(tasks), "op1-groups")

    def met(meetings: DataFrame) -> DataFrame:
        """Links among the pairs of ``meetings`` (doc_id, with)."""
        pairs = meetings.select(F.least("doc_id", "with").alias("a"), F.greatest("doc_id", "with").alias("b"))
        pairs = pairs.filter("a < b").distinct().coalesce(tasks)
        pairs = pairs.join(side("b"), F.col("b") == F.col("doc_id_b")).coalesce(busy)
        pairs = pairs.join(side("a"), F.col("a") == F.col("doc_id_a"))
        pairs = written(pairs.filter(likely()).select("a", "b").coalesce(busy), "op1-pairs")
        return _confirmed(pairs, texts, width, percent, busy)

    def outside(roots: DataFrame) -> DataFrame:
        """``groups`` of three and more with ``root``, ``main`` (the largest component's) and sizes."""
        rooted = groups.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rooted = written(rooted.withColumn("root", F.coalesce("root", "doc_id")).coalesce(tasks), "op1-rooted")
        parts = rooted.groupBy("centre", "root").agg(F.count(F.lit(1)).alias("members")).coalesce(tasks)
        mains = parts.groupBy("centre").agg(
            F.max(F.struct("members", "root")).alias("_m"), F.sum("members").alias("size")
        )
        mains = mains.select("centre", F.col("_m.root").alias("main"), F.col("_m.members").alias("inside"), "size")
        mains = mains.filter("size > 2 AND inside < size").withColumn("left_out", F.col("size") - F.col("inside"))
        return written(rooted.join(written(mains.coalesce(tasks), "op1-mains"), "centre").coalesce(tasks), "op1-outside")

    links = met(groups.select("doc_id", F.col("centre").alias("with")))
    first = components(links, "op1", tasks)

    # The others in a group meet a centre of their own.
    found = outside(first)
    others = found.filter("root != main")
    second = others.groupBy("centre").agg(F.min(F.struct("alone", "doc_id")).alias("_c"))
    second = written(second.select("centre", F.col("_c.doc_id").alias("with")).coalesce(tasks), "op1-second")
    more = met(others.join(second, "centre"))
    if not more.isEmpty():
        links = written(links.unionByName(more).coalesce(tasks), "op1-two")
        first = components(links, "op1", tasks)

    # Those still outside meet everything in the group, in blocks.
    found = outside(first)
    sets = _window_sets(texts.join(found.select("doc_id").distinct(), "doc_id").select("doc_id", "text"), width)
    full = written(sets.join(shares, "doc_id").coalesce(busy), "op1-sets")
    known = found.join(full, "doc_id")
    rows, cols = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("left_out", "size"))
    own = F.xxhash64("doc_id")
    columns = ["centre", "row", "col", "doc_id", "root", "main", "n", "shared", "planes", "grams"]

    def spread(x: str, df: DataFrame, row: Column, col: Column) -> DataFrame:
        dealt = df.withColumn("row", row).withColumn("col", col)
        return dealt.select(*(F.col(c).alias(f"{c}_{x}") for c in columns))

    a = spread("a", known.filter("root != main"), F.pmod(own, rows).cast("int"), F.explode(F.sequence(F.lit(0), cols - 1)))
    b = spread("b", known, F.explode(F.sequence(F.lit(0), rows - 1)), F.pmod(own, cols).cast("int"))
    same_block = (
        (F.col("centre_a") == F.col("centre_b")) & (F.col("row_a") == F.col("row_b")) & (F.col("col_a") == F.col("col_b"))
    )
    # Both outside: once is enough. In one component: nothing to find.
    apart = (F.col("root_a") != F.col("root_b")) & (
        (F.col("root_b") == F.col("main_b")) | (F.col("doc_id_a") < F.col("doc_id_b"))
    )
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    linked = 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)
    rest = a.join(b, same_block & apart & likely() & linked)
    rest = rest.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
    rest = written(rest.coalesce(busy).distinct().coalesce(tasks), "op1-rest")
    if not rest.isEmpty():
        more = _confirmed(rest, texts, width, percent, busy)
        first = components(links.unionByName(more), "op1", tasks)

    rooted = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = written(rooted.select(*print_of, "_id", F.coalesce("root", "rep").alias("root")).coalesce(tasks), "op1-labels")
    least = rooted.groupBy("root").agg(F.min("_id").alias("_component"))
    labelled = rooted.join(least, "root").select(*print_of, "root", "_component")
    labelled = written(labelled.coalesce(tasks), "op1-labelled")
    for table in (rest, links, full, found, second, groups, placed, centres, shares, texts, buckets, reps, classes, rooted):
        discard(table)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("_component"))
    return (
        signed.select(*named, *print_of)
        .join(labelled, print_of, "left")
        .coalesce(tasks)
        .select(*named, "n", "root", component.alias("component_id"))
    )
