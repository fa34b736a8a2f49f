"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring. A document's id hashes to one of CELLS equal arcs
of the ring (a cell), whose home is the shard of the next point clockwise. A shard takes
cells until it holds ``1 + slack`` times the mean load; a cell that does not fit goes on
clockwise to the next shard with room. A cell far above the mean, such as that of an id which many rows
share, is cut into parts of about the mean, each at a place of its own on the ring. Only the loads
of the cells and parts, at most 2 * CELLS numbers, reach the driver, so this is the same work there for
any input.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.words import mix
from linewright.plans.scratch import written

CELLS = 1 << 16
POINTS = 512  # virtual nodes per shard
SLACK = 0.0002  # a shard holds at most this much more than the mean
HEAVY = 16  # times the mean load from which a cell is cut


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """Sorted (place, shard); a shard's points do not depend on the other shards."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), points)
    point = np.tile(np.arange(points, dtype=np.uint64), shards)
    places = mix(mix(shard + np.uint64(1)) ^ point)
    return sorted(zip(places.tolist(), shard.tolist()))


def place_cells(loads: dict[int, int], shards: int, slack: float = SLACK) -> dict[int, int]:
    """Shard of each cell. Heavy cells go first (ties by hash), so light ones fill the gaps.

    A number from CELLS on is a part of the cell that it is modulo CELLS, and lies on the ring by its hash.
    What no shard has room for goes to the shard with the least load.
    """
    nodes = ring(shards)
    places = [p for p, _ in nodes]
    room = [sum(loads.values()) * (1 + slack) / shards] * shards
    turn = dict(zip(loads, mix(np.array(list(loads), dtype=np.uint64)).tolist()))
    out = {}
    for cell in sorted(loads, key=lambda c: (-loads[c], turn[c])):
        start = bisect.bisect_left(places, turn[cell] if cell >= CELLS else cell * (2**64 // CELLS))
        tried: set[int] = set()
        for i in range(len(nodes)):
            shard = nodes[(start + i) % len(nodes)][1]
            if shard in tried:
                continue
            if room[shard] >= loads[cell]:
                break
            tried.add(shard)
            if len(tried) == shards:
                shard = max(range(shards), key=lambda s: (room[s], -s))
                break
        room[shard] -= loads[cell]
        out[cell] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = SLACK) -> DataFrame:
    """Place of every row of ``docs`` (doc_id, text, anything else) under the law ``bytes``.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text, null none, plus 1), ``text_crc32``,
    ``law``, ``shard``, ``slot`` (0, 1, .. within the shard) and ``grown_shard`` (null: with
    bounded loads other rows have a say too). Shard sizes are near equal: at most ``1 + slack``
    times the mean, unless single cells are heavier than that leaves room for.

    Rows that share a doc_id share a cell, or, when these are heavier than HEAVY mean cells, are dealt over
    its parts by content and place in the table; rows without an id are spread by their content. Slots
    follow content within a cell or part. Other columns are ignored; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    place = F.xxhash64(F.coalesce("doc_id", "text_crc32"))
    cell = F.shiftrightunsigned(place, 64 - (CELLS.bit_length() - 1)).cast("int")
    rows = rows.withColumn("_cell", cell).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "op10-rows")

    # At most CELLS rows, whatever the input; so are the heavy ones together with their parts.
    spark = docs.sparkSession
    loads = {r["_cell"]: r["load"] for r in rows.groupBy("_cell").agg(F.sum("size").alias("load")).collect()}
    mean = sum(loads.values()) / CELLS
    cut = [(cell, max(1, int(load / mean))) for cell, load in loads.items() if load > HEAVY * mean]
    parts = F.broadcast(spark.createDataFrame(cut, "_cell int, _parts int"))
    part = F.coalesce(F.pmod(F.xxhash64("text_crc32", "size", "_at"), F.col("_parts")), F.lit(0))
    rows = rows.join(parts, "_cell", "left")
    rows = rows.withColumn("_cell", F.col("_cell") + CELLS * part).drop("_parts")

    found = rows.groupBy("_cell").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).collect()
    shard_of = place_cells({r["_cell"]: r["load"] for r in found}, shards, slack)
    filled = [0] * shards
    table = []
    for r in sorted(found, key=lambda r: r["_cell"]):
        shard = shard_of[r["_cell"]]
        table.append((r["_cell"], shard, filled[shard]))
        filled[shard] += r["n"]
    cells = spark.createDataFrame(table, "_cell bigint, shard int, _before bigint")

    inside = Window.partitionBy("_cell").orderBy("size", "text_crc32", "_at")
    ranked = rows.withColumn("_row", F.row_number().over(inside).cast("bigint") - 1)
    return ranked.join(F.broadcast(cells), "_cell").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
