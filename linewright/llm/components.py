"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.scratch import discard, written


def components(links: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the component's smallest node.

    Each round every node takes the smallest of its neighbours and then that one's choice;
    links between the chosen nodes remain for the next round. A star is done in one round and
    long chains at least halve. Minima combine before the shuffle, so a hub is no hot task.
    ``tasks`` is the most that write a table of a round; without it, one per shuffle partition.
    """

    def packed(df: DataFrame) -> DataFrame:
        return df if tasks is None else df.coalesce(tasks)

    known: DataFrame | None = None
    edges = links
    while True:
        ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = packed(ways.groupBy("a").agg(F.min("b").alias("_b")))
        chosen = written(
            nearest.select(F.col("a").alias("node"), F.least("a", "_b").alias("root")), f"{label}-chosen"
        )
        jump = chosen.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        chosen2 = written(
            packed(chosen.join(jump, "root").select("node", F.col("_next").alias("root"))), f"{label}-roots"
        )
        discard(chosen)
        if known is None:
            total = chosen2
        else:
            step = chosen2.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            total = written(
                packed(known.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))),
                f"{label}-known",
            )
            discard(known)
        a = chosen2.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        b = chosen2.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        rest = packed(packed(edges.join(a, "a")).join(b, "b").filter("_ra != _rb"))
        rest = rest.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct()
        rest = written(packed(rest), f"{label}-edges")
        if edges is not links:
            discard(edges)
        if known is not None:
            discard(chosen2)
        known, edges = total, rest
        if edges.isEmpty():
            discard(edges)
            return known
