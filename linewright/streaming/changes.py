"""Live change log: each row is compared with the last value of its key, which Spark keeps as keyed state.

State, offsets and output commits lie in the query's checkpoint, so a batch that is run again
finds the state from before it, and its rows land once. A batch reads and writes the state of
its own keys only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linewright.streaming.follow import land

#: What a query needs while it starts: the store of arbitrary keyed state, and batches only when there are
#: rows (a time-to-live would otherwise make batches without end).
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _same(a: object, b: object) -> bool:
    """Equality in which NULL equals NULL and NaN equals NaN."""
    return a == b or (a != a and b != b)


class LastValue(StatefulProcessor):
    """Rows of a key that differ from the row before, which may have come in an earlier batch."""

    def __init__(
        self, order: Sequence[str], value: T.StructField, columns: Sequence[str], idle: timedelta | None
    ) -> None:
        self.order, self.value, self.columns, self.idle = list(order), value, list(columns), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.idle is None else int(self.idle.total_seconds() * 1000)
        self.last = handle.getValueState("last", T.StructType([self.value]), ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        value, change = self.value.name, Row(*self.columns, "prev")
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        # NULL first, as Spark sorts.
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            if known and not _same(row[value], last):
                yield change(*(row[c] for c in self.columns), last)
            known, last = True, row[value]
        self.last.update((last,))

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """A query keeps the settings that hold when it starts; the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def changes(
    stream: DataFrame, key: Sequence[str], order: Sequence[str], value: str, idle: timedelta | None = None
) -> DataFrame:
    """The stream of changes: the columns of ``stream`` and ``prev``, as ``change_log`` gives them.

    The first row of a key is the initial set and no change. NULL is a value, and a key, like any.
    Rows of one key in one batch are taken in the order of ``order``, batches as they arrive, so a late row is
    compared with what arrived before it. With ``idle`` a key not seen for so long is forgotten; its next
    value is then a first one.

    A task sorts the rows that one key has in one batch; bound the batches at their source
    (``files_per_batch``) where a key may have more than fit.
    """
    field = stream.schema[value]
    out = T.StructType([*stream.schema.fields, T.StructField("prev", field.dataType)])
    processor = LastValue(order, field, stream.columns, idle)
    mode = "None" if idle is None else "ProcessingTime"
    return stream.groupBy(*key).transformWithState(processor, out, "Append", mode)


def change_stream(
    stream: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    checkpoint: str,
    available_now: bool = True,
    idle: timedelta | None = None,
) -> StreamingQuery:
    """Write ``changes`` to ``out`` as they arrive, each exactly once.

    ``checkpoint`` holds the last values: a query that is started again with it carries on from them.
    """
    with _settings(stream.sparkSession):
        return land(changes(stream, key, order, value, idle), out, checkpoint, available_now)


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """All changes written so far."""
    return spark.read.parquet(out)
