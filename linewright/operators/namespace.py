"""Listings of the tree that a column of paths spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.paths import segments


def _prefixes(parts: Column, depth: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), depth), "/")


def _levels(df: DataFrame, location: Column) -> DataFrame:
    """One row per path and depth (from 1): ``_parts`` and ``depth``."""
    cut = df.select(segments(location).alias("_parts"))
    depths = F.when(F.size("_parts") > 0, F.sequence(F.lit(1), F.size("_parts")))
    # The outer form keeps Catalyst from inferring a size filter that cuts paths twice.
    return cut.select("_parts", F.explode_outer(depths).alias("depth")).filter("depth IS NOT NULL")


def namespace_listing(df: DataFrame, location: Column) -> DataFrame:
    """Immediate children of every directory: ``parent``, ``child``, ``is_dir``, ``n_paths``.

    The parent of the top level is the empty string. A child is a directory when some
    path goes deeper. Partial groups combine before the one shuffle.
    """
    levels = _levels(df, location)
    entries = levels.select(
        _prefixes(F.col("_parts"), F.col("depth") - 1).alias("parent"),
        F.get(F.col("_parts"), F.col("depth") - 1).alias("child"),
        (F.col("depth") < F.size("_parts")).alias("deeper"),
    )
    return entries.groupBy("parent", "child").agg(
        F.bool_or("deeper").alias("is_dir"), F.count(F.lit(1)).alias("n_paths")
    )


def namespace_counts(df: DataFrame, location: Column) -> DataFrame:
    """Number of entries of every directory."""
    listing = namespace_listing(df, location)
    return listing.groupBy("parent").agg(F.count(F.lit(1)).alias("n_entries"))


def namespace_tree(df: DataFrame, location: Column) -> DataFrame:
    """Every path and all its ancestors: ``path``, ``depth``, ``n_paths`` at or below."""
    levels = _levels(df, location)
    nodes = levels.select(
        _prefixes(F.col("_parts"), F.col("depth")).alias("path"),
        F.col("depth").cast("bigint").alias("depth"),
    )
    return nodes.groupBy("path", "depth").agg(F.count(F.lit(1)).alias("n_paths"))
