"""Completion of prefixes from a written index of sorted lines.

The index is a table of blocks: each row has the same number of lines, sorted by their
UTF-8 bytes. A small second table has the first line of every block. All lines with a prefix follow one
another, so a prefix is answered by two numbers: the lines before it and the lines before the end of its
range. No line is opened into its heads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.plans.ranking import global_rank
from linewright.plans.scratch import written
from linewright.plans.sizing import fits_broadcast

#: Lookups that touch at most so many blocks have their numbers pushed down to the scan,
#: as at most so many ranges of numbers.
MOST_BLOCKS, MOST_RANGES = 4096, 64


def write_index(
    corpus: DataFrame, path: str, line: str = "line", rows_per_block: int = 256
) -> None:
    """Write the lines of ``corpus`` as an index at ``path``, a new folder; null lines are left out.

    Equal lines stay. A block is one row, so ``rows_per_block`` lines have to fit a cell.
    """
    if rows_per_block < 1:
        raise ValueError("rows_per_block must be at least 1")
    keys = corpus.select(F.encode(F.col(line), "UTF-8").alias("key")).filter("key IS NOT NULL")
    placed = global_rank(keys, ["key"]).select(
        "key", F.expr(f"(rank - 1) div {rows_per_block}").alias("block")
    )
    # The range exchange keeps a block in one task, so the grouping needs no other.
    blocks = placed.repartitionByRange("block").groupBy("block").agg(
        F.array_sort(F.collect_list("key")).alias("keys")
    )
    blocks.sortWithinPartitions("block").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    read = corpus.sparkSession.read.parquet(f"{path}/blocks")
    read.select("block", F.get("keys", F.lit(0)).alias("key"), F.lit(rows_per_block).alias("per_block")).write.parquet(
        f"{path}/firsts"
    )


def covering(numbers: list[int], most: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ``numbers``, which are sorted; the widest gaps stay open."""
    gaps = sorted(range(1, len(numbers)), key=lambda i: numbers[i - 1] - numbers[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if numbers[i] - numbers[i - 1] > 1), len(numbers)]
    return [(numbers[a], numbers[b - 1]) for a, b in zip(cuts, cuts[1:])]


def _touched(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Blocks that may be among ``numbers``: pruned by the statistics of row groups if there are few."""
    some = numbers.distinct().limit(MOST_BLOCKS + 1).collect()
    if not some or len(some) > MOST_BLOCKS:
        return blocks
    ranges = covering(sorted(r[0] for r in some), MOST_RANGES)
    return blocks.filter(reduce(Column.__or__, (F.col("block").between(a, b) for a, b in ranges)))


def _join(blocks: DataFrame, side: DataFrame) -> DataFrame:
    side = written(side, "block-side")
    found = _touched(blocks, side.select("block"))
    return found.join(F.broadcast(side) if fits_broadcast(side) else side, "block")


def look_up(
    path: str,
    queries: DataFrame,
    k: int,
    query: str = "query",
    line: str = "line",
    empty_asks_all: bool = False,
) -> DataFrame:
    """The first ``k`` lines of the index that start with each query: query, ``rank`` from 1, line.

    Lines come in code point order, equal ones each for itself. Null queries give nothing, nor does an
    empty one unless ``empty_asks_all``. Queries are made distinct.

    The ends of each query's range are sorted among the first lines of all blocks, which says in
    which block each end lies; those blocks alone are searched, and those that hold answers read.
    """
    spark = queries.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    firsts = spark.read.parquet(f"{path}/firsts")
    one = firsts.select("per_block").first()
    per_block = one[0] if one else 1
    asked = queries.select(F.col(query).alias("_query")).filter("_query IS NOT NULL").distinct()
    if not empty_asks_all:
        asked = asked.filter("_query <> ''")
    key = F.encode("_query", "UTF-8")
    # No UTF-8 text has the byte FF, so the prefix with it comes after all that begin with the prefix.
    ends = F.array(
        F.struct(key.alias("key"), F.lit(0).alias("kind")),
        F.struct(F.concat(key, F.lit(bytearray(b"\xff"))).alias("key"), F.lit(1).alias("kind")),
    )
    marks = written(asked.select("_query", F.explode(ends).alias("_end")).select("_query", "_end.*"), "marks")
    none = F.lit(None)
    both = marks.select("key", F.lit(0).alias("_first"), "_query", "kind").unionByName(
        firsts.select("key", F.lit(1).alias("_first"), none.cast("string").alias("_query"), none.cast("int").alias("kind"))
    )
    # Rank among marks and first lines, less the rank among marks: the first lines before a mark.
    among_all = global_rank(both, ["key", "_first"], "_all").filter("_first = 0").drop("_first")
    among_marks = global_rank(marks.select("key"), ["key"], "_own").withColumnRenamed("key", "_key")
    placed = among_all.join(among_marks, F.col("key") == F.col("_key")).select(
        "_query", "kind", "key", F.greatest(F.col("_all") - F.col("_own") - 1, F.lit(0)).alias("block")
    )
    before = F.col("block") * per_block + F.size(F.filter("keys", lambda x: x < F.col("key")))
    found = _join(blocks, placed).select("_query", "kind", before.alias("_before"))
    spans = found.groupBy("_query").agg(
        F.min(F.when(F.col("kind") == 0, F.col("_before"))).alias("_from"),
        F.max(F.when(F.col("kind") == 1, F.col("_before"))).alias("_to"),
    )
    stop = F.least("_to", F.col("_from") + k)
    wanted = spans.select("_query", "_from", stop.alias("_stop")).filter("_stop > _from")
    wanted = wanted.withColumn(
        "block", F.explode(F.expr(f"sequence(_from div {per_block}, (_stop - 1) div {per_block})"))
    )
    base = F.col("block") * per_block
    start = F.greatest(F.col("_from") - base, F.lit(0)).cast("int")
    size = (F.least(F.col("_stop") - base, F.lit(per_block)) - start).cast("int")
    held = _join(blocks, wanted).select(
        "_query", (base + start - F.col("_from")).alias("_shift"), F.posexplode(F.slice("keys", start + 1, size))
    )
    return held.select(
        F.col("_query").alias(query),
        (F.col("_shift") + F.col("pos") + 1).alias("rank"),
        F.decode("col", "UTF-8").alias(line),
    )
