"""Exact duplicates: 128-bit content hash, then a comparison of the bytes inside groups.

Only Spark SQL functions. Grouping is by hash, so rows of any length travel as 16 bytes;
of texts that share a hash, the smallest and the largest are aggregated (salted tasks combine before the last
shuffle, so a group of any size is no hot task) and must be the same bytes.
Where they are not, a collision, that group is split by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.plans.scratch import discard, written

#: The six characters that do not count (fixed values).
BLANKS = " \t\n\x0b\f\r"

SALTS = 1024  # parts that the rows of one hash are dealt into


def normalised(text: Column) -> Column:
    """The text without BLANKS; null counts as empty.

    One replacement after the other: each runs over bytes, faster than a regular expression.
    """
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _groups(rows: DataFrame, by: str) -> DataFrame:
    """The row that stays in each group (longest, then smallest id, then number) and the group's size."""
    rank = F.struct(
        F.when(F.col("doc_id").isNotNull(), F.col("_length")).alias("length"),
        F.bitwise_not("doc_id").alias("turned"),  # falls as the id rises
        F.when(F.col("doc_id").isNull(), F.col("_length")).alias("other_length"),
        F.bitwise_not("_number").alias("turned_number"),
    )
    return (
        rows.groupBy(by)
        .agg(F.max(rank).alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .select(
            by,
            F.col("_best.length").alias("_most"),
            F.bitwise_not("_best.turned").alias("keep_id"),
            F.bitwise_not("_best.turned_number").alias("_stays"),
            "group_size",
        )
    )


def exact_duplicates(
    docs: DataFrame, content_hash: Callable[[Column], Column] = md5_128, number: str | None = None
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, anything else), those that go included.

    Texts are equal when identical without BLANKS; null counts as empty. Of equal texts the
    row with the most code points in its original text stays, of these the one with the
    smallest doc_id. Returns ``doc_id``, ``keep_id`` (doc_id of the row that stays),
    ``group_size``, ``kept`` and ``text_sha256`` (lowercase hex of the normalised text).

    A null doc_id never stays while its group has another; a group of null ids only has a
    null keep_id, and its rows are not kept. Repeats of a whole row each count in group_size
    and share one verdict. Other columns are ignored; an empty table gives no rows.

    ``number`` names a column of ``docs`` that tells rows apart. It is then returned too, and just one
    row of each group is kept: of several rows that could be, and of null ids only, the longest, then
    the one with the smallest number.

    ``content_hash`` is a parameter so that tests can force collisions.
    """
    hashed = docs.select(
        "doc_id",
        F.col(number or "doc_id").alias("_number"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("_length"),
        normalised(F.col("text")).alias("_text"),
    ).withColumn("_hash", content_hash(F.col("_text")))
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    rows = written(hashed.select("doc_id", "_number", "_length", "_hash", digest), "op3-rows")
    groups = written(_groups(rows, "_hash"), "op3-groups")

    shared = groups.filter("group_size > 1").select("_hash")
    # Adaptive execution splits a frequent hash in the join, and salts deal its rows out again,
    # so that only the smallest and largest text of each task meet in the last step.
    salt = (F.rand(3) * SALTS).cast("int")  # not by id: copies may share one, or have none
    members = hashed.select("_hash", "_text").join(shared, "_hash").withColumn("_salt", salt)
    members = members.repartition("_hash", "_salt")
    apart = members.groupBy("_hash").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"))
    collided = written(apart.filter("_lo != _hi").select("_hash"), "op3-collided")

    settled = rows.join(groups, "_hash")
    if collided.isEmpty():
        discard(collided)
    else:  # different texts under one hash: group these rows by their texts
        clashing = written(hashed.join(collided, "_hash"), "op3-clashing")
        split = clashing.join(_groups(clashing, "_text"), "_text").withColumn("text_sha256", digest)
        settled = settled.join(collided, "_hash", "left_anti")
        settled = settled.unionByName(split.select(settled.columns))
    stays = (F.col("doc_id") == F.col("keep_id")) & (F.col("_length") == F.col("_most"))
    named = []
    if number is not None:
        stays, named = F.col("_number") == F.col("_stays"), [F.col("_number").alias(number)]
    stays = F.coalesce(stays, F.lit(False)).alias("kept")
    return settled.select("doc_id", "keep_id", "group_size", stays, "text_sha256", *named)
