"""Change rows from a stream of observed values, in the order of their event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType


MICROS = "micros_of_time"


class _Changes(StatefulProcessor):
    """Rows wait in list state until the watermark has passed their time; then they are compared in order, each with the one before
    it, and the key's last value is kept.

    Whatever the files' order, no row that is still to come can lie before a released one. A key has one timer, for its earliest
    waiting row.
    """

    def __init__(self, order: list[str], values: list[str], first: bool, row: StructType) -> None:
        self.order, self.values, self.first, self.row = order, values, first, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.last = handle.getValueState("last", StructType([StructField(v, StringType()) for v in self.values]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            self.waiting.appendList(list(zip(*[part[c] for c in self.row.names])))
            first = int(part[MICROS].min()) // 1000
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None and not any(timer <= earliest for timer in self.handle.listTimers()):
            self.handle.registerTimer(earliest)
        yield pd.DataFrame(columns=self.row.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The watermark counts in whole milliseconds.
        at, passed = self.row.names.index(MICROS), timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in self.waiting.get():
            (due if row[at] // 1000 <= passed else later).append(tuple(row))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(min(row[at] for row in later)) // 1000)
        else:
            self.waiting.clear()
        yield pd.DataFrame(self._compared(due), columns=self.row.names)

    def _compared(self, rows: list[tuple]) -> list[tuple]:
        """The rows that differ from the one before them. A key has few rows at a time, so they are compared as they are: a frame for
        each would cost more than the rows, and would turn whole numbers next to a missing one into fractions."""
        if not rows:
            return []
        missing = lambda v: v is None or v != v
        order, values = ([self.row.names.index(c) for c in names] for names in (self.order, self.values))
        rows = sorted(rows, key=lambda row: [(True, 0) if missing(row[i]) else (False, row[i]) for i in order])
        stored = self.last.get() if self.last.exists() else None
        before = None if stored is None else tuple(stored)
        changed = []
        for row in rows:
            now = tuple("" if missing(row[i]) else str(row[i]) for i in values)
            if now != before if before is not None else self.first:
                changed.append(row)
            before = now
        self.last.update(before)
        return changed

    def close(self) -> None:
        pass


def stream_changes(
    events: DataFrame, key: str, time: str, order: list[str], values: list[str], first: bool = False, delay: str = "1 hour"
) -> DataFrame:
    """Rows whose values differ from the key's previous row by ``time`` (a timestamp) and then ``order``; with ``first`` a key's first
    row counts as well. Missing texts compare as empty.

    Rows may come up to ``delay`` late, in any files: a row is compared once the watermark has passed it. A row that is later still
    is left out, as Spark does with late rows. Rows behind the last watermark stay in the state until later ones come. A key keeps the
    rows of one delay and its last value. Rows without a key or a time only move the watermark, so such a row (with a time)
    lets everything before it go.

    The session has to keep state in RocksDB (``build_session`` sets it).
    """
    # A condition on the key alone would be moved below the watermark, which would then not see rows without a key.
    known = F.when(F.col(time).isNotNull(), F.col(key).isNotNull()).otherwise(False)
    rows = events.withWatermark(time, delay).where(known)
    # In the state times are whole microseconds, whatever zone a worker lives in.
    rows = rows.withColumn(MICROS, F.unix_micros(time))
    kept = rows.select(*dict.fromkeys([key, MICROS, *[c for c in (*order, *values) if c != time]]))
    processor = _Changes([MICROS, *[c for c in order if c != time]], values, first, kept.schema)
    found = rows.select(*kept.columns, time).groupBy(key).transformWithStateInPandas(
        processor, outputStructType=kept.schema, outputMode="append", timeMode="EventTime"
    )
    return found.select(key, F.timestamp_micros(MICROS).alias(time), *kept.columns[2:])
