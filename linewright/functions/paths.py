"""Path and URL expressions with POSIX rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: paths with this prefix are absolute URIs and stay as they are.
PASS_THROUGH = "hdfs://"


def url_path(url: Column) -> Column:
    """The path of a URL; scheme, authority, query and fragment are dropped."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def url_location(url: Column) -> Column:
    """``host/path`` of a URL; scheme, query and fragment are dropped."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def segments(path: Column) -> Column:
    """The non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def join_path(path: Column, cwd: Column) -> Column:
    return (
        F.when(F.startswith(path, F.lit("/")), path)
        .when((cwd == "") | F.endswith(cwd, F.lit("/")), F.concat(cwd, path))
        .otherwise(F.concat(cwd, F.lit("/"), path))
    )


def _fold_parents(parts: Column, absolute: Column) -> Column:
    """Resolve ``..`` parts; at the root of an absolute path they vanish."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        depth = F.size(done)
        stuck = (depth == 0) | (F.get(done, depth - 1) == "..")
        return (
            F.when(part != "..", F.array_append(done, part))
            .when((depth == 0) & absolute, done)
            .when(stuck, F.array_append(done, part))
            .otherwise(F.slice(done, F.lit(1), depth - 1))
        )

    folded = F.aggregate(parts, none, step)
    return F.when(F.array_contains(parts, ".."), folded).otherwise(parts)


def real_parts(joined: Column) -> Column:
    """The parts of a path that count: neither empty nor ``.``."""
    return F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))


def normal_path(joined: Column, parts: Column) -> Column:
    """Collapse slashes, drop ``.`` and resolve ``..``; ``parts`` = ``real_parts(joined)``.

    Exactly two leading slashes stay two, as POSIX asks. Both arguments should be
    plain columns, since they are read from a lambda.
    """
    rooted = F.startswith(joined, F.lit("/"))
    root = (
        F.when(F.rlike(joined, F.lit(r"\A//(?!/)")), F.lit("//"))
        .when(rooted, F.lit("/"))
        .otherwise(F.lit(""))
    )
    full = F.concat(root, F.array_join(_fold_parents(parts, rooted), "/"))
    return F.when(full == "", F.lit(".")).otherwise(full)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    head = F.left(path, F.length(path) - F.length(base_name(path)))
    bare = F.rtrim(head, F.lit("/"))
    return F.when(bare == "", head).otherwise(bare)


def leaf_name(path: Column) -> Column:
    """Name shown for a directory: its last part, ``/`` for the root."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(bare == "", F.lit("/")).otherwise(base_name(bare))
