"""Streaming queries, each run over all data there is and read back from what it wrote."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.registry import query
from estatelake.registry.pages import SITE, _sale_pages
from estatelake.registry.tables import Tables, with_views
from estatelake.session import shared_folder
from estatelake.sources.tables import read_log, read_table
from estatelake.streaming.changes import stream_changes as changes
from estatelake.streaming.ingest import stream_pages, stream_upsert
from estatelake.streaming.windows import dedupe_stream, open_windows, stream_counts


def _stream(t: Tables) -> DataFrame:
    """The event file as a stream."""
    reader = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet")
    return reader.option("maxFilesPerTrigger", 1).parquet(t.path)


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _run(t: Tables, stream: DataFrame) -> DataFrame:
    """Runs a stream to the end of its input and reads back what it wrote."""
    folder = _folder(t)
    running = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _run_with_state(t: Tables, stream: DataFrame) -> DataFrame:
    """The same for a stream with state of its own, which has to be kept in RocksDB whatever the session keeps otherwise."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _run(t, stream)
    finally:
        t.spark.conf.set(name, before)


def _arrivals(t: Tables) -> DataFrame:
    """The events as four files that arrive one after the other, by quarters of their time; a tenth of the events of a quarter's last day
    come a file late, and a last file without events moves the watermark past all of them."""
    events = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 4
    at = lambda time: F.floor((F.unix_micros(time) - F.unix_micros(F.lit(low))) / int(step.total_seconds() * 1e6)).cast("int")
    late = (F.col("event_id") % 10 == 0) & (at(F.col("ts") + F.expr("INTERVAL 1 DAY")) > at(F.col("ts")))
    events = events.withColumn("part", F.least(at(F.col("ts")) + late.cast("int"), F.lit(3)))
    folder = _folder(t)
    end = t.spark.createDataFrame([(high + timedelta(days=3),)], "ts timestamp")
    for n in range(4):
        events.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/events")
    for c in events.drop("part", "ts").schema:
        end = end.withColumn(c.name, F.lit(None).cast(c.dataType))
    end.write.mode("append").parquet(f"{folder}/events")
    return t.spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR p <> event_type""")
def stream_first_and_changes(t: Tables):
    """Unit mode: the first value and every change of it."""
    return _run_with_state(t, changes(_arrivals(t), "user_id", "ts", ["event_id"], ["event_type"], first=True, delay="2 days")).drop("ts")


@query("""SELECT user_id, event_id, value, event_type FROM (SELECT *, lag(value) OVER w AS v, lag(event_type) OVER w AS p, row_number()
    OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND (p <> event_type OR v <> value)""")
def stream_changes(t: Tables):
    return _run_with_state(t, changes(_arrivals(t), "user_id", "ts", ["event_id"], ["value", "event_type"], delay="2 days")).drop("ts")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables):
    items = _stream(t).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _run(t, dedupe_stream(items, ["user_id", "event_type"], "ts", "60 days")).drop("ts")


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS items,
    count(*) FILTER (value < 10) AS new_items, count(*) FILTER (value >= 10 AND value < 30) AS updated_items FROM events
    GROUP BY 1, 2""")
def stream_window_counts(t: Tables):
    """Windows the watermark has passed, and from the rows themselves those it has not."""
    status = F.when(F.col("value") < 10, "new").when(F.col("value") < 30, "updated").otherwise("unchanged")
    timed = lambda rows: rows.select("event_type", status.alias("metric_status"), F.col("ts").cast("timestamp").alias("ts"))
    closed = _run(t, stream_counts(timed(_stream(t)), ["event_type"], "ts", "6 hours"))
    rows = closed.unionByName(open_windows(timed(t.raw("events")), ["event_type"], "ts", "6 hours"))
    return rows.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "items", "new_items", "updated_items"
    )


_CRAWLS: dict[tuple, str] = {}


def _crawled(t: Tables) -> str:
    """The stored tables after two crawls, which the queries about them share within a session."""
    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _CRAWLS:
        _CRAWLS[key] = _crawl(t)
    return _CRAWLS[key]


def _crawl(t: Tables) -> str:
    """Two crawls of the orders' pages through the ingest stream: in the second one, finished orders are cheaper by the
    digit at the end of their price and the others unchanged."""
    folder = _folder(t)
    first = _sale_pages(t).select(
        "page_id", F.concat(F.lit("https://listings.example/list?ar=030&bs=021&ta=13&pn="), F.col("page_id") + 1).alias("url"),
        F.lit("property-list").alias("kind"), "html",
    )
    cheaper = F.regexp_replace("html", r"([0-9])万円</span></dl>", "万円</span></dl>")
    done = t.raw("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("page_id"), F.lit(True).alias("done"))
    second = first.join(done, "page_id", "left").withColumn("html", F.when(F.col("done"), cheaper).otherwise(F.col("html"))).drop("done")
    day = lambda n: F.to_timestamp(F.lit(f"2024-02-0{n + 1} 00:00:00"))
    for crawl in (first, second):
        crawl.write.mode("append").parquet(f"{folder}/pages")
        stream_upsert(stream_pages(t.spark, f"{folder}/pages"), f"{folder}/tables", SITE, f"{folder}/state", day, buckets=16).awaitTermination()
    return f"{folder}/tables"


_CRAWL = """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, o_orderstatus = 'F' AS moved, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders"""


@query(with_views("", """SELECT source_id, CASE WHEN moved THEN n // 10 ELSE n END * 10000 AS price, CASE WHEN moved THEN n // 10 ELSE n END || '万円' AS price_text,
    '030' AS region, '13' AS province, '中古一戸建て' AS property_type, CASE WHEN moved THEN '2024-02-02' ELSE '2024-02-01' END AS updated FROM crawl""", crawl=_CRAWL))
def stream_upserted_listings(t: Tables):
    rows = read_table(t.spark, _crawled(t), "listing")
    return rows.select(
        "source_id", "price", "price_text", "region", "province", "property_type",
        F.date_format("last_updated", "yyyy-MM-dd").alias("updated"),
    )


@query(with_views("", "SELECT (n // 10) * 10000 AS price, '2024-02-02' AS recorded FROM crawl WHERE moved", crawl=_CRAWL))
def stream_upserted_history(t: Tables):
    rows = read_log(t.spark, _crawled(t), "price_history")
    return rows.select("price", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded"))


@query("SELECT '021' AS section_type, '030' AS region, '13' AS province, count(*) AS listings FROM orders")
def stream_counts_refreshed(t: Tables):
    """Counts per area as the batches kept them up to date."""
    return read_table(t.spark, _crawled(t), "area_count").where("listings > 0")


@query(with_views("", """SELECT CAST(1 AS BIGINT) AS version, count(*) AS items, count(*) AS new_items, CAST(0 AS BIGINT) AS updated_items, CAST(0 AS BIGINT) AS unchanged_items FROM crawl
    UNION ALL SELECT 2, count(*), 0, count(*) FILTER (moved), count(*) FILTER (NOT moved) FROM crawl""", crawl=_CRAWL))
def stream_observed_metrics(t: Tables):
    """Counters of each batch, observed while its counters per page were written."""
    return read_log(t.spark, _crawled(t), "batch_metric")


@query("""SELECT o_orderkey + 1 AS page, 2 AS items, 1 AS new_items, CAST((o_orderstatus = 'F') AS BIGINT) AS updated_items,
    CAST((o_orderstatus <> 'F') AS BIGINT) AS unchanged_items FROM orders""")
def stream_page_metrics(t: Tables):
    """Counters of each page over both crawls."""
    counters = ["items", "new_items", "updated_items", "unchanged_items"]
    rows = read_log(t.spark, _crawled(t), "page_metric").groupBy(F.col("page").cast("long").alias("page"))
    return rows.agg(*[F.sum(c).alias(c) for c in counters])
