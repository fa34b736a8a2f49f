"""Values that paths inherit from the folders above them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.paths import segments
from linewright.plans.scratch import written
from linewright.plans.sizing import sized_join


def inherit(
    df: DataFrame,
    location: Column,
    rules: DataFrame,
    rule_location: Column,
    values: Sequence[str],
    order: str | None = None,
) -> DataFrame:
    """Each row with the ``values`` of the rule for its path or its nearest folder above.

    Paths are compared part by part, so empty parts and a slash at either end make no
    difference; a rule for the empty path holds everywhere. ``rule_depth`` says how many parts the
    rule has; it and the values are null where no rule holds, also for a null path. Rules with a null path
    hold nowhere. Of several rules for one path the last by ``order`` holds, else the one with the greatest values.

    For every depth that rules have there is one equi-join on the head of that many parts, from the
    deepest up: rows are neither copied nor paired, and small rule tables need no exchange. The joins
    are sized, so a folder that most paths lie in is no hot key. The number of joins
    is that of the different depths of rules.
    """
    parts = segments(rule_location)
    rank = Window.partitionBy("_path").orderBy(*[F.col(c).desc() for c in ([order] if order else []) + list(values)])
    known = rules.select(F.array_join(parts, "/").alias("_path"), F.size(parts).alias("_depth"), *rules.columns)
    best = known.filter("_path IS NOT NULL").withColumn("_n", F.row_number().over(rank)).filter("_n = 1")
    best = written(best.select("_path", "_depth", F.struct(*values).alias("_held")), "rules")
    depths = sorted((r[0] for r in best.select("_depth").distinct().collect()), reverse=True)

    out = df.withColumn("_parts", segments(location))
    found, holds = [], []
    for i, depth in enumerate(depths):
        side = best.filter(F.col("_depth") == depth).select(
            F.col("_path").alias(f"_path{i}"), F.col("_held").alias(f"_held{i}")
        )
        head = F.when(F.size("_parts") >= depth, F.array_join(F.slice("_parts", 1, depth), "/"))
        out = sized_join(out.withColumn("_head", head), side, {"_head": f"_path{i}"}, "left")
        found.append(F.when(F.col(f"_held{i}").isNotNull(), F.lit(depth)))
        holds.append(F.col(f"_held{i}"))
    held = F.coalesce(*holds) if holds else None
    types = {f.name: f.dataType for f in rules.schema.fields}
    return out.select(
        *df.columns,
        (F.coalesce(*found) if found else F.lit(None).cast("int")).alias("rule_depth"),
        *[(held.getField(v) if holds else F.lit(None).cast(types[v])).alias(v) for v in values],
    )
