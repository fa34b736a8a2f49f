"""Filters and row-by-row field work. No operator here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import paths, text

# The alias grammar, host specs and host numbers.
ALIAS_PATTERN = r"(\w+)\s*=\s*(\w+)(?:\s+-([hlc]))?((?:\s+-\w+)*)"
SPEC_LIST = r"\w+(?:,\w+)*"
SPEC_RANGE = r"(\w+)\[(\d+)-(\d+)\]"
HOST_NUMBER = r"[a-zA-Z]+([0-9]+)"


def grep_lines(
    df: DataFrame,
    pattern: str,
    literal: bool = False,
    ignore_case: bool = False,
    invert: bool = False,
    line: str = "line",
) -> DataFrame:
    """Rows whose line matches a regex or holds a literal; ``invert`` keeps the others."""
    hit = text.line_test(pattern, literal, ignore_case)(F.col(line))
    return df.filter(~hit if invert else hit)


def validate_route(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Add ``ok``: the whole value matches. One pass serves both routes."""
    return df.withColumn("ok", text.full_match(F.col(column), pattern))


def route(df: DataFrame, column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows that match in full, and the refused ones."""
    checked = validate_route(df, column, pattern)
    return checked.filter("ok").drop("ok"), checked.filter("NOT ok").drop("ok")


def token_columns(df: DataFrame, column: str) -> DataFrame:
    """Add ``n_tokens``, ``n_plain`` (not starting with ``-``) and ``verb`` (first token)."""
    value = F.col(column)
    counted = df.withColumn("n_tokens", text.token_count(value).cast("bigint"))
    return counted.select(
        *df.columns,
        "n_tokens",
        (F.col("n_tokens") - text.option_count(value)).cast("bigint").alias("n_plain"),
        text.first_token(value).alias("verb"),
    )


def token_profile(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Token counts summed per group; partial sums combine before the shuffle."""
    counted = token_columns(df.select(*by, column), column)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_plain").alias("n_plain"),
    )


def path_profile(df: DataFrame, column: str, cwd: Column) -> DataFrame:
    """Add ``abs_path``, ``base``, ``parent`` and ``leaf`` of a path seen from ``cwd``."""
    path = F.col(column)
    joined = df.withColumn("_joined", paths.join_path(path, cwd))
    cut = joined.withColumn("_parts", paths.real_parts(F.col("_joined")))
    full = cut.withColumn(
        "abs_path",
        F.when(F.startswith(path, F.lit(paths.PASS_THROUGH)), path).otherwise(
            paths.normal_path(F.col("_joined"), F.col("_parts"))
        ),
    )
    return full.select(
        *df.columns,
        "abs_path",
        paths.base_name(F.col("abs_path")).alias("base"),
        paths.dir_name(F.col("abs_path")).alias("parent"),
        paths.leaf_name(F.col("abs_path")).alias("leaf"),
    )


def extract_fields(
    df: DataFrame, pattern: str, names: Sequence[str], column: str = "line"
) -> DataFrame:
    """Rows that match ``pattern``, with its capture groups as columns ``names``."""
    found = df.filter(F.rlike(F.col(column), F.lit(pattern)))
    return found.withColumns(
        {n: F.regexp_extract(column, pattern, i + 1) for i, n in enumerate(names)}
    )


def parse_aliases(df: DataFrame, column: str) -> DataFrame:
    """Read ``name=verb [-h|-l|-c] [-option..]`` into name, verb, scope and option.

    Lines outside the grammar are dropped. No mode letter means the hdfs table.
    """
    found = extract_fields(
        df, rf"\A(?:{ALIAS_PATTERN})\z", ["name", "verb", "_mode", "_options"], column
    )
    scope = (
        F.when(F.col("_mode") == "c", F.lit("common"))
        .when(F.col("_mode") == "l", F.lit("local"))
        .otherwise(F.lit("hdfs"))
    )
    # Like the repeated group of the grammar, the last option is the one kept.
    option = F.coalesce(F.element_at(F.split(F.trim("_options"), r"\s+"), -1), F.lit(""))
    return found.withColumns({"scope": scope, "option": option}).drop("_mode", "_options")


def split_explode(df: DataFrame, column: str, sep: str) -> DataFrame:
    """One row per element of a separated value: adds ``pos`` and ``element``."""
    pieces = F.split(F.col(column), text.quoted(sep))
    return df.select("*", F.posexplode(pieces).alias("pos", "element"))


def ensure_element(df: DataFrame, column: str, value: Column, at: int = 1) -> DataFrame:
    """Insert ``value`` at 0-based ``at`` of an array unless the array has it."""
    array = F.col(column)
    place = F.least(F.lit(at), F.size(array)) + 1
    # Taking the array apart keeps a short array short; array_insert would pad it.
    grown = F.concat(
        F.slice(array, F.lit(1), place - 1),
        F.array(value),
        F.slice(array, place, F.size(array)),
    )
    return df.withColumn(column, F.when(F.array_contains(array, value), array).otherwise(grown))


def server_lines(df: DataFrame, column: str) -> DataFrame:
    """Add ``server``: the cluster member line of a host, numbered by the digits in its name.

    A host without letters before digits has no number and gets NULL.
    """
    host = F.col(column)
    number = F.regexp_extract(host, HOST_NUMBER, 1)
    line = F.concat(F.lit("server."), number, F.lit("="), host, F.lit(":2888:3888"))
    return df.withColumn("server", F.when(number != "", line))


def truncate_text(df: DataFrame, column: str, n: int) -> DataFrame:
    """Keep the first ``n`` characters and tell with ``cut`` whether any were lost."""
    return df.withColumns(
        {column: F.left(F.col(column), F.lit(n)), "cut": F.length(column) > n}
    )
