"""Change log of a watched value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.ranking import with_previous
from linewright.plans.sizing import HOT_ROWS


def change_log(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows whose value differs from the row before, per key: adds ``prev``.

    The first row of a key is the initial set and is not reported. NULL is a value:
    going to or from it is a change. ``order`` should be unique per key. Keys above
    ``max_rows`` rows are spread over many tasks.
    """
    seen = with_previous(df, key, order, value, max_rows)
    differs = ~F.col(value).eqNullSafe(F.col("prev"))
    return seen.filter(~F.col("is_first") & differs).drop("is_first")
