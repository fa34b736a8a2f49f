"""Joins: spec expansion, fan-out, lookups, upserts, deltas, prefix completion."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import full_match
from linewright.operators.filters import SPEC_LIST, SPEC_RANGE
from linewright.plans.ranking import early_cut, group_rank
from linewright.plans.scratch import written
from linewright.plans.sizing import all_equal, fits_broadcast

# A range is opened level by level, RANGE_STEP parts each, so no row ever holds a long array.
RANGE_STEP = 100_000
RANGE_LEVELS = 3
MOST_HOSTS = 10**18

# Bounds are kept as text; arithmetic is done on this many of their last digits.
TAIL_DIGITS = 36
WIDE = "decimal(38,0)"


def _power() -> Column:
    return F.lit("1" + "0" * TAIL_DIGITS).cast(WIDE)


@lru_cache(maxsize=1)
def _other_digits() -> tuple[str, str]:
    """Decimal digits of all scripts but ASCII, and the ASCII digit of each."""
    found = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def _successor(digits: Column) -> Column:
    """The next number after a string of digits; an empty string stands for zero."""
    kept = F.rtrim(digits, F.lit("9"))
    nines = F.char_length(digits) - F.char_length(kept)
    last = F.right(kept, F.lit(1)).cast("int") + 1
    grown = F.concat(F.left(kept, F.char_length(kept) - 1), last.cast("string"))
    return F.concat(F.when(kept == "", "1").otherwise(grown), F.repeat(F.lit("0"), nines))


def _number_from(head: Column, tail: Column, offset: Column) -> Column:
    """Digits of ``head * 10**TAIL_DIGITS + tail + offset``, without leading zeros."""
    total = tail + offset.cast("decimal(20,0)")
    # A carry out of the tail adds one to the head, once at most.
    carried = total >= _power()
    rest = F.when(carried, total - _power()).otherwise(total).cast(WIDE).cast("string")
    start = F.when(carried, _successor(head)).otherwise(head)
    return F.when(start == "", rest).otherwise(F.concat(start, F.lpad(rest, TAIL_DIGITS, "0")))


def expand_specs(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """One row per host of ``name[a-b]`` or ``n1,n2,..``: adds ``host_no`` and ``host``.

    Bounds are inclusive numbers of any length, so leading zeros are lost and a reversed
    range is empty. Anything else gives no rows. A range of more than MOST_HOSTS hosts, which
    no table could hold, stops the job with a message.
    """
    value = F.col(spec)
    pattern = "(?U)" + SPEC_RANGE
    form = specs.withColumns(
        {"_range": full_match(value, pattern), "_list": full_match(value, "(?U)" + SPEC_LIST)}
    )
    cut = form.withColumn("_stem", F.regexp_extract(value, pattern, 1))
    for name, group in (("_lo", 2), ("_hi", 3)):
        digits = F.translate(F.regexp_extract(value, pattern, group), *_other_digits())
        cut = cut.withColumn(name, F.ltrim(digits, F.lit("0")))
        size = F.char_length(name)
        tail = F.nullif(F.right(name, F.least(size, F.lit(TAIL_DIGITS))), F.lit(""))
        cut = cut.withColumns(
            {
                f"{name}_head": F.left(name, F.greatest(size - TAIL_DIGITS, F.lit(0))),
                f"{name}_tail": F.coalesce(tail, F.lit("0")).cast(WIDE),
            }
        )
    by_size = F.char_length("_hi") - F.char_length("_lo")
    below = (by_size < 0) | ((by_size == 0) & (F.col("_hi") < F.col("_lo")))
    count = (
        F.when(F.col("_hi_head") == F.col("_lo_head"), F.col("_hi_tail") - F.col("_lo_tail") + 1)
        .when(
            F.col("_hi_head") == _successor(F.col("_lo_head")),
            F.col("_hi_tail") + (_power() - F.col("_lo_tail")) + 1,
        )
        .otherwise(_power())
    )
    too_wide = F.raise_error(F.concat(F.lit("range too wide: "), value)).cast("bigint")
    size = (
        F.when(F.col("_list"), F.lit(1).cast("bigint"))
        .when(~F.col("_range") | below, F.lit(0).cast("bigint"))
        .when(count > MOST_HOSTS, too_wide)
        .otherwise(count.cast("bigint"))
    )
    opened = cut.withColumns({"_size": size, "_skip": F.lit(0).cast("bigint")}).filter("_size > 0")
    for level in reversed(range(RANGE_LEVELS)):
        step = RANGE_STEP**level
        last = F.expr(f"(_size - _skip - 1) div {step}")
        if level < RANGE_LEVELS - 1:
            last = F.least(last, F.lit(RANGE_STEP - 1).cast("bigint"))
        # The outer form keeps Catalyst from inferring a filter that works all this out twice.
        opened = opened.withColumn("_at", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last)))
        opened = opened.withColumn("_skip", F.col("_skip") + F.col("_at") * step).drop("_at")
    # Up to 18 digits a number and its offset fit a bigint, which is the same and cheaper.
    plain = F.when(F.char_length("_lo") <= 18, F.col("_lo_tail").cast("bigint")) + F.col("_skip")
    long = _number_from(F.col("_lo_head"), F.col("_lo_tail"), F.col("_skip"))
    number = F.when(F.char_length("_lo") <= 18, plain.cast("string")).otherwise(long)
    name = F.concat("_stem", number)
    hosts = F.when(F.col("_list"), F.split(value, ",")).otherwise(F.array(name))
    return opened.select(*specs.columns, "_skip", F.posexplode(hosts).alias("_at", "host")).select(
        *specs.columns, (F.col("_skip") + F.col("_at")).cast("bigint").alias("host_no"), "host"
    )


def spec_expand_join(
    specs: DataFrame, df: DataFrame, key: str, spec: str = "spec"
) -> DataFrame:
    """Rows of ``df`` named by each spec: an equi-join on the expanded host.

    Output, whatever the sizes: the columns of ``specs``, ``host_no``, ``host``, then those of
    ``df``. A column of ``df`` whose name is already taken comes out as ``<name>_of_row``, but a
    key called ``host`` is not repeated. Adaptive execution sends a small side round and
    splits frequent hosts on either side.
    """
    hosts = expand_specs(specs, spec)
    taken = {c.lower() for c in hosts.columns}
    inner = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    joined = hosts.join(df.select(*(F.col(c).alias(n) for c, n in inner.items())), F.col("host") == F.col(inner[key]))
    rows = [
        F.col(n).alias(f"{c}_of_row" if c.lower() in taken else c)
        for c, n in inner.items()
        if not (c == key and c.lower() == "host")
    ]
    return joined.select(*hosts.columns, *rows)


def fan_out(df: DataFrame, targets: Sequence[str], name: str = "target") -> DataFrame:
    """Every row once per target, in target order (``target_no``).

    Targets are the short list a caller writes down, so they travel inside the plan as
    an array: each row is opened where it lies, without a join.
    """
    listed = F.array(*[F.lit(t) for t in targets]).cast("array<string>")
    opened = df.select("*", F.posexplode(listed).alias("target_no", name))
    return opened.withColumn("target_no", F.col("target_no").cast("bigint"))


def lookup_precedence(
    df: DataFrame, key: str, aliases: DataFrame, hdfs_mode: Column
) -> DataFrame:
    """Replace an alias by its verb and option.

    ``aliases`` has ``scope`` (common, hdfs or local), ``name``, ``verb``, ``option`` and
    ``no`` (a later entry of the same scope and name wins). The common table comes
    first, then the hdfs table when ``hdfs_mode`` holds, then the local table in either
    mode. Adds ``verb`` and ``option``; an unknown name is its own verb.
    """
    meaning = F.struct("verb", "option")
    table = aliases.groupBy(F.col("name").alias("_name")).agg(
        *[
            F.max_by(meaning, F.when(F.col("scope") == s, F.col("no"))).alias(f"_{s}")
            for s in ("common", "hdfs", "local")
        ]
    )
    found = df.join(table, F.col(key) == F.col("_name"), "left")
    chosen = F.coalesce(
        F.col("_common"), F.when(hdfs_mode, F.col("_hdfs")), F.col("_local")
    )
    return found.withColumn("_meaning", chosen).select(
        *df.columns,
        F.coalesce(F.col("_meaning.verb"), F.col(key)).alias("verb"),
        F.coalesce(F.col("_meaning.option"), F.lit("")).alias("option"),
    )


def apply_aliases(
    df: DataFrame, tokens: str, aliases: DataFrame, hdfs_mode: Column
) -> DataFrame:
    """Rewrite token 0 of a command by alias and insert the option after it."""
    first = df.withColumn("_first", F.get(F.col(tokens), F.lit(0)))
    found = lookup_precedence(first, "_first", aliases, hdfs_mode)
    rest = F.slice(tokens, F.lit(2), F.size(tokens))
    head = F.when(F.col("option") == "", F.array("verb")).otherwise(F.array("verb", "option"))
    known = F.col("_first").isNotNull()
    return found.withColumn(
        tokens, F.when(known, F.concat(head, rest)).otherwise(F.col(tokens))
    ).select(*df.columns)


def keyed_upsert(target: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop every row of an updated key, then add the update rows. NULL is a key like any.

    An anti join needs each key once or often, so nothing is made distinct or measured first.
    """
    keys = updates.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)))
    same = all_equal({k: f"_key{i}" for i, k in enumerate(key)}, null_safe=True)
    return target.join(keys, same, "left_anti").unionByName(updates)


def member_filter(
    df: DataFrame, members: DataFrame, on: dict[str, str], negate: bool = False
) -> DataFrame:
    """Rows whose key is (or, negated, is not) among ``members``.

    ``on`` maps columns of ``df`` to columns of ``members``. A NULL key is no member.
    """
    keys = members.select(*(F.col(m).alias(f"_key{i}") for i, m in enumerate(on.values())))
    same = all_equal({k: f"_key{i}" for i, k in enumerate(on)})
    return df.join(keys, same, "left_anti" if negate else "left_semi")


def sync_delta(src: DataFrame, dst: DataFrame, key: Sequence[str]) -> DataFrame:
    """Compare two tables by key: ``status`` is added, changed, same or target_only.

    One full outer join: a row has the source values as ``src`` and the target values as
    ``dst``. NULL is a key like any. Keys should be unique on each side; repeated ones give a row
    per pair, so that none is lost.
    """
    values = [c for c in src.columns if c not in key]

    def side(df: DataFrame, name: str) -> DataFrame:
        keys = (F.col(k).alias(f"_{name}{i}") for i, k in enumerate(key))
        return df.select(*keys, F.struct(*values).alias(name), F.lit(True).alias(f"_in_{name}"))

    same = all_equal({f"_src{i}": f"_dst{i}" for i in range(len(key))}, null_safe=True)
    both = side(src, "src").join(side(dst, "dst"), same, "full_outer")
    status = (
        F.when(F.col("_in_dst").isNull(), "added")
        .when(F.col("_in_src").isNull(), "target_only")
        .when(F.col("src").eqNullSafe(F.col("dst")), "same")
        .otherwise("changed")
    )
    keys = [F.coalesce(f"_src{i}", f"_dst{i}").alias(k) for i, k in enumerate(key)]
    return both.select(*keys, "src", "dst", status.alias("status"))


def apply_delta(delta: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The target after sending: source values where there are any, else its own rows."""
    row = F.coalesce(F.col("src"), F.col("dst"))
    return delta.select(*key, *[row.getField(v).alias(v) for v in values])


def prefix_complete(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query: str = "query",
    line: str = "line",
    order: Sequence[str] = (),
    empty_asks_all: bool = False,
) -> DataFrame:
    """The first ``k`` corpus lines that start with each query.

    Lines come in code point order, or in that of the corpus columns ``order`` (candidates
    as their source lists them; ties by the line). Duplicates in the corpus stay. An empty query gives
    nothing unless ``empty_asks_all``. Output: query, ``rank`` from 1, line.

    Each line is looked up by its own heads of those lengths that some query has: an
    equi-join, no pairwise comparison. Per-task top-k runs before the shuffle, so a
    prefix shared by most of the corpus stays small.
    """
    asked = queries.select(F.col(query).alias("_head")).filter("_head IS NOT NULL").distinct()
    if not empty_asks_all:
        asked = asked.filter("_head <> ''")
    asked = written(asked, "asked")  # read three times below
    by = [*(f"_o{i}" for i in range(len(order))), "_line"]
    lengths = asked.agg(F.collect_set(F.length("_head"))).scalar()
    lines = corpus.select(
        F.col(line).alias("_line"),
        *[F.col(c).alias(o) for c, o in zip(order, by)],
        lengths.alias("_lengths"),
    )
    heads = lines.select(
        *dict.fromkeys(["_line", *by]),
        F.explode(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.length("_line")),
                lambda n: F.left(F.col("_line"), n),
            )
        ).alias("_head"),
    )
    window = Window.partitionBy("_head").orderBy(*by)

    def best(df: DataFrame) -> DataFrame:
        if k > early_cut(df):
            ranked = group_rank(df, ["_head"], by, "_rank")
        else:
            ranked = df.withColumn("_rank", F.row_number().over(window))
        return ranked.filter(F.col("_rank") <= k)

    if fits_broadcast(asked):
        found = best(heads.join(F.broadcast(asked), "_head"))
    else:
        # Too many queries to send round: cut to k per head first, which bounds every
        # head to k rows before the join.
        found = best(heads).join(asked, "_head")
    return found.select(
        F.col("_head").alias(query), F.col("_rank").cast("bigint").alias("rank"), F.col("_line").alias(line)
    )
