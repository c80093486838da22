"""Changes from a stream whose files come out of order."""

import datetime as dt

from pyspark.sql import functions as F
from test_jobs import rows

from estatelake.streaming.changes import stream_changes

DAY = dt.datetime(2026, 1, 1)
EVENT = "k string, at timestamp, n long, v string"


def test_files_out_of_order_give_the_changes_in_order(spark, tmp_path):
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    arrivals = [
        [("a", at(0), 1, "x"), ("a", at(30), 3, "y"), ("b", at(10), 1, None)],
        [("a", at(20), 2, "x"), ("b", at(50), 2, ""), ("b", at(55), 3, "z")],  # the first one is late, within the hour
        [("a", at(200), 4, "y"), ("a", at(201), 6, "x"), ("a", at(201), 5, "w")],
        [("c", at(202), 1, "n"), (None, at(203), 1, "m"), ("c", None, 2, "o")],
        [("a", at(1), 9, "q")],  # too late: the rows before minute 141 are compared by now
        [(None, at(999), 0, None)],
    ]
    for events in arrivals:
        spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for first, want in ((False, []), (True, [("a", 1, "x"), ("b", 1, None), ("c", 1, "n")])):
        found = stream_changes(stream, "k", "at", ["n"], ["v"], first=first)
        out = f"{tmp_path}/out{first}"
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(found.schema).parquet(out)
        changes = [("a", 3, "y"), ("a", 5, "w"), ("a", 6, "x"), ("b", 3, "z")]
        assert sorted(rows(got, "k", "n", "v"), key=repr) == sorted(changes + want, key=repr)
        assert got.where(F.col("at") == at(30)).count() == 1


def test_whole_numbers_beside_a_missing_one_compare_as_they_are():
    from pyspark.sql.types import LongType, StructField, StructType

    from estatelake.streaming.changes import MICROS, _Changes

    class State:
        def __init__(self, rows=()):
            self.rows, self.value, self.timers = list(rows), None, []

        def get(self):
            return iter(self.rows) if self.value is None else self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        registerTimer = put
        getCurrentWatermarkInMs = lambda self: 10

    names = [MICROS, "n", "value"]
    changes = _Changes([MICROS, "n"], ["value"], False, StructType([StructField(c, LongType()) for c in names]))
    changes.handle, changes.last = State(), State()
    found = []
    for rows in ([(1000, 1, None), (2000, 2, 7)], [(3000, 3, 7), (4000, None, 8), (4000, 4, 7)]):
        changes.waiting = State(rows)
        for part in changes.handleExpiredTimer(None, State(), None):
            found += [int(v) for v in part["value"]]
        assert not changes.waiting.rows
    assert found == [7, 8]
