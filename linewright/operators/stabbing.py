"""Rows whose host lies in a range spec, without opening the range.

A range of numbers is a handful of blocks of the form *so many digits, beginning with these*:
``[95-1203]`` is 95 to 99, three digits of any kind, 10.. and 11.. with two more digits, and so
on. A number lies in just one block of each range that holds it, and has one beginning of each
length; so range and number meet in an equi-join whose size follows the digits of the bounds,
not the width of the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import full_match
from linewright.operators.filters import SPEC_LIST, SPEC_RANGE
from linewright.operators.joins import _other_digits

DIGITS = [str(d) for d in range(10)]


def _blocks_beside(bound: Column, start: Column, above: bool) -> Column:
    """Blocks of the numbers with as many digits as ``bound`` and the same first ``start`` ones
    that are greater (or smaller) than it."""
    places = F.filter(F.sequence(F.lit(0), F.char_length(bound) - 1), lambda k: k >= start)

    def of_place(k: Column) -> Column:
        here = F.substr(bound, k + 1, F.lit(1))
        digits = F.filter(
            F.array(*map(F.lit, DIGITS)),
            # A number of several digits does not begin with zero.
            lambda d: (d > here) if above else (d < here) & ((k > 0) | (d > "0") | (F.char_length(bound) == 1)),
        )
        return F.transform(digits, lambda d: F.concat(F.left(bound, k), d))

    return F.flatten(F.transform(places, of_place))


def _blocks(low: Column, high: Column) -> Column:
    """Disjoint blocks ``(size, head)`` of the numbers from ``low`` to ``high``, digits without
    leading zeros; an empty array if there are none."""
    small, large = F.char_length(low), F.char_length(high)

    def sized(size: Column, heads: Column) -> Column:
        return F.transform(heads, lambda h: F.struct(size.alias("size"), h.alias("head")))

    shared = F.size(F.filter(F.sequence(F.lit(1), small), lambda k: F.left(low, k) == F.left(high, k)))
    middle = F.transform(
        F.filter(
            F.array(*map(F.lit, DIGITS)),
            lambda d: (d > F.substr(low, shared + 1, F.lit(1))) & (d < F.substr(high, shared + 1, F.lit(1))),
        ),
        lambda d: F.concat(F.left(low, shared), d),
    )
    same_size = F.concat(
        F.array(low), F.array(high), middle, _blocks_beside(low, shared + 1, True), _blocks_beside(high, shared + 1, False)
    )
    between = F.filter(F.sequence(small, F.greatest(large, small)), lambda n: (n > small) & (n < large))
    other_size = F.concat(
        sized(small, F.concat(F.array(low), _blocks_beside(low, F.lit(0), True))),
        F.transform(between, lambda n: F.struct(n.alias("size"), F.lit("").alias("head"))),
        sized(large, F.concat(F.array(high), _blocks_beside(high, F.lit(0), False))),
    )
    one = sized(small, F.array(low))
    return (
        F.when(low == high, one)
        .when((small == large) & (low < high), sized(small, same_size))
        .when(small < large, other_size)
        .otherwise(F.filter(one, lambda _: F.lit(False)))
    )


def spec_stab_join(specs: DataFrame, df: DataFrame, key: str, spec: str = "spec") -> DataFrame:
    """Rows of ``df`` whose ``key`` is a host of a spec: ``name[a-b]`` or ``n1,n2,..``.

    The rows of ``joins.spec_expand_join``, but ranges have any width: nothing is opened, and
    there is no greatest number of hosts. Output: the columns of ``specs``; ``host_no``, the place
    in the spec from 0 as ``decimal(38,0)``, null if a bound or number has more than 38 digits; the
    columns of ``df``. Of these, ``<name>_of_row`` are those whose name is taken. Bounds are read
    as there: leading zeros are lost, a reversed range is empty, anything else gives no rows.
    Null specs and keys match nothing; repeated specs, rows and hosts of a list each give theirs.

    A key is split before each of its last digits, as a name may end in digits too; what no spec
    has the name and number of digits of goes before the beginnings are opened. All joins are on
    equal values, so adaptive execution sends small sides round and splits frequent keys.
    """
    value, pattern = F.col("_spec.spec"), "(?U)" + SPEC_RANGE
    taken = {c.lower() for c in specs.columns} | {"host_no"}
    asked = specs.select(F.struct(F.col(spec).alias("spec"), F.struct(*specs.columns).alias("row")).alias("_spec"))
    rows = df.select(F.col(key).alias("_host"), F.struct(*df.columns).alias("_row")).filter("_host IS NOT NULL")

    def bound(group: int) -> Column:
        digits = F.ltrim(F.translate(F.regexp_extract(value, pattern, group), *_other_digits()), F.lit("0"))
        return F.when(digits == "", "0").otherwise(digits)

    ranges = asked.filter(full_match(value, pattern)).select(
        "_spec", F.regexp_extract(value, pattern, 1).alias("stem"), bound(2).alias("low"), bound(3).alias("high")
    )
    blocks = ranges.select("_spec", "stem", "low", F.explode(_blocks(F.col("low"), F.col("high"))).alias("_b")).select(
        "_spec", "stem", "low", F.col("_b.size").alias("size"), F.col("_b.head").alias("head")
    )
    # At most one length for each digit of the longest bound.
    lengths = blocks.groupBy("stem", "size").agg(F.collect_set(F.char_length("head")).alias("_lengths"))
    tail = F.char_length(F.regexp_extract("_host", r"([0-9]*)\z", 1))
    cuts = rows.withColumn("_tail", tail).filter("_tail > 0")
    cuts = cuts.select("_host", "_row", F.explode(F.sequence(F.lit(1), F.col("_tail"))).alias("size"))
    cuts = cuts.select(
        "_row",
        "size",
        F.left("_host", F.char_length("_host") - F.col("size")).alias("stem"),
        F.right("_host", F.col("size")).alias("number"),
    ).filter("stem <> '' AND (size = 1 OR left(number, 1) <> '0')")
    heads = cuts.join(lengths, ["stem", "size"]).select("*", F.explode("_lengths").alias("_length"))
    heads = heads.withColumn("head", F.left("number", F.col("_length")))
    number_no = F.col("number").try_cast("decimal(38,0)") - F.col("low").try_cast("decimal(38,0)")
    of_ranges = heads.join(blocks, ["stem", "size", "head"]).select(
        "_spec", number_no.cast("decimal(38,0)").alias("host_no"), "_row"
    )

    lists = asked.filter(full_match(value, "(?U)" + SPEC_LIST)).select(
        "_spec", F.posexplode(F.split(value, ",")).alias("_at", "_host")
    )
    of_lists = lists.join(rows, "_host").select("_spec", F.col("_at").cast("decimal(38,0)").alias("host_no"), "_row")

    found = of_ranges.unionByName(of_lists)
    return found.select(
        *[F.col("_spec.row").getField(c).alias(c) for c in specs.columns],
        "host_no",
        *[F.col("_row").getField(c).alias(f"{c}_of_row" if c.lower() in taken else c) for c in df.columns],
    )
