"""String and token expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LineTest = Callable[[Column], Column]


def quoted(text: str) -> str:
    """A Java regex that matches ``text`` literally."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def line_test(pattern: str, literal: bool = False, ignore_case: bool = False) -> LineTest:
    """Build a test of one line. A NULL line matches nothing."""
    if literal and not ignore_case:
        return lambda line: F.coalesce(F.contains(line, F.lit(pattern)), F.lit(False))
    regex = quoted(pattern) if literal else pattern
    if ignore_case:
        regex = "(?iu)" + regex
    return lambda line: F.coalesce(F.rlike(line, F.lit(regex)), F.lit(False))


def full_match(value: Column, pattern: str) -> Column:
    """True when the whole of ``value`` matches; NULL does not."""
    return F.coalesce(F.rlike(value, F.lit(rf"\A(?:{pattern})\z")), F.lit(False))


def split_lines(text: Column) -> Column:
    """Array of the lines of a text, without their terminators.

    A terminator at the very end opens no further line and an empty text has no
    lines. Texts without carriage returns take the single-character split.
    """
    unix = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    mixed = F.split(F.regexp_replace(text, r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    empty = F.array().cast("array<string>")
    return (
        F.when(text == "", empty)
        .when(F.contains(text, F.lit("\r")), mixed)
        .when(F.endswith(text, F.lit("\n")), unix)
        .otherwise(F.split(text, "\n"))
    )


# What parts tokens: whitespace of any script, and the separators 1C-1F.
_BLANK = r"\s\x1c-\x1f"


def tokens(text: Column) -> Column:
    """Tokens between whitespace (of any script, and the separators 1C-1F), empties dropped."""
    return F.filter(F.split(text, rf"(?U)[{_BLANK}]+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Number of ``tokens``, without making them."""
    return F.regexp_count(text, F.lit(rf"(?U)[^{_BLANK}]++"))


def option_count(text: Column) -> Column:
    """Number of ``tokens`` that are options; texts without a dash are not searched."""
    found = F.regexp_count(text, F.lit(rf"(?U)(?<![^{_BLANK}])-"))
    return F.when(F.contains(text, F.lit("-")), found).when(text.isNotNull(), F.lit(0))


def first_token(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?U)[^{_BLANK}]++", 0), F.lit(""))


def home_variable(name: Column) -> Column:
    """Name of an environment variable: upper case, ``_HOME`` added when missing."""
    upper = F.upper(name)
    ending = F.lit("_HOME")
    return F.when(F.endswith(upper, ending), upper).otherwise(F.concat(upper, ending))


def is_option(token: Column) -> Column:
    return F.startswith(token, F.lit("-"))
