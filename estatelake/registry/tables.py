"""The given tables seen as listings, buildings, units, stations, lines and price history, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Domain tables over one folder of Parquet files. Every property is lazy and reads only the columns used."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """The table's narrow rows spread over all cores, for queries that first write a page from each row."""
        return self.raw(name).repartition(self.spark.sparkContext.defaultParallelism, key)

    @cached_property
    def places(self) -> DataFrame:
        """Customers with the region and province of their nation."""
        return self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "c_name", "c_mktsegment", "c_acctbal", "n_name",
            F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").cast("string").alias("province"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        price = F.col("o_totalprice")
        return self.raw("orders").join(self.places, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").cast("string").alias("source_id"),
            F.round(price * 300).cast("long").alias("price"),
            F.col("o_orderpriority").alias("section_type"),
            "region", "province",
            F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(price / 4000).alias("building_area"),
            (price / 5000).alias("area"),
            F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.month("o_orderdate")).alias("walking_minutes"),
            F.col("o_orderdate").alias("last_updated"),
            F.col("n_name").alias("state"), F.col("c_name").alias("title"), F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def building(self) -> DataFrame:
        return self.raw("orders").join(self.places, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("source_id"),
            F.col("c_name").alias("title"), "region", "province", F.col("o_orderdate").alias("last_updated"),
        )

    @cached_property
    def unit(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("building_id"), F.round("l_extendedprice").cast("long").alias("rent"),
            F.col("l_quantity").alias("size"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("station_id"),
            F.col("l_linenumber").alias("floor"),
        )

    @cached_property
    def station(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
            F.lit(None).cast("string").alias("translated_name"), F.col("s_nationkey").cast("long").alias("train_line_id"),
        )

    @cached_property
    def line(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
            F.when(F.col("n_regionkey") > 0, F.concat(F.lit("Line "), F.col("n_name"))).alias("translated_name"),
            F.when(F.col("n_regionkey") == 1, "bus").otherwise("rail").alias("kind"),
            F.when(F.col("n_regionkey") == 2, F.concat(F.lit("Canonical "), F.col("n_name"))).alias("canonical_name"),
        )

    @cached_property
    def link(self) -> DataFrame:
        return self.raw("lineitem").groupBy(
            F.col("l_orderkey").alias("building_id"), F.col("l_suppkey").alias("station_id")
        ).agg(F.min("l_linenumber").alias("walking_minutes"))

    @cached_property
    def history(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("property_id"), F.round(F.col("value") * 100).cast("long").alias("price"),
            F.col("props").alias("price_text"), F.col("ts").alias("recorded_at"), "event_id",
        )

    @cached_property
    def run(self) -> DataFrame:
        """Orders as ingest runs: a status, a start, and the shipping of the last line as the end of finished ones."""
        names = {"O": "running", "F": "completed", "P": "failed"}
        status = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("o_orderstatus")]
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("start_time")
        )

    @cached_property
    def observation(self) -> DataFrame:
        """Events as observed listings: one key per user and event type."""
        digit = F.substring("props", 7, 1)
        return self.raw("events").select(
            F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("source_id"),
            F.col("user_id"), F.col("event_type").alias("section_type"),
            F.floor(F.col("value") / 20).cast("long").alias("price"),
            F.when(F.length("props") == 8, "").otherwise("text").alias("price_text"),
            F.when(digit < "5", "A").otherwise("B").alias("region"),
            F.when(digit < "8", "a").otherwise("b").alias("province"),
            "ts", "event_id",
        )


# The same tables for SQL: each entry is one common table expression.
VIEWS = {
    "places": """SELECT c_custkey, c_name, c_mktsegment, c_acctbal, n_name,
        CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS province
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "listing": """SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS source_id,
        CAST(round(o_totalprice * 300) AS BIGINT) AS price, o_orderpriority AS section_type, region, province,
        CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice / 4000 END AS building_area,
        o_totalprice / 5000 AS area,
        CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE month(o_orderdate) END AS INTEGER) AS walking_minutes,
        o_orderdate AS last_updated, n_name AS state, c_name AS title, o_orderstatus AS status
        FROM orders JOIN places ON o_custkey = c_custkey""",
    "building": """SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS source_id, c_name AS title, region, province,
        o_orderdate AS last_updated FROM orders JOIN places ON o_custkey = c_custkey""",
    "unit": """SELECT l_orderkey AS building_id, CAST(round(l_extendedprice) AS BIGINT) AS rent, l_quantity AS size,
        l_partkey AS part, l_suppkey AS station_id, l_linenumber AS floor FROM lineitem""",
    "station": """SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS translated_name,
        CAST(s_nationkey AS BIGINT) AS train_line_id FROM supplier""",
    "line": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
        CASE WHEN n_regionkey > 0 THEN 'Line ' || n_name END AS translated_name,
        CASE WHEN n_regionkey = 1 THEN 'bus' ELSE 'rail' END AS kind,
        CASE WHEN n_regionkey = 2 THEN 'Canonical ' || n_name END AS canonical_name FROM nation""",
    "link": """SELECT l_orderkey AS building_id, l_suppkey AS station_id, min(l_linenumber) AS walking_minutes
        FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "history": """SELECT user_id AS property_id, CAST(round(value * 100) AS BIGINT) AS price, props AS price_text,
        ts AS recorded_at, event_id FROM events""",
    "run": """SELECT o_orderkey AS id,
        CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
        o_orderdate AS start_time FROM orders""",
    "observation": """SELECT user_id || '-' || event_type AS source_id, user_id, event_type AS section_type,
        CAST(floor(value / 20) AS BIGINT) AS price,
        CASE WHEN length(props) = 8 THEN '' ELSE 'text' END AS price_text,
        CASE WHEN substr(props, 7, 1) < '5' THEN 'A' ELSE 'B' END AS region,
        CASE WHEN substr(props, 7, 1) < '8' THEN 'a' ELSE 'b' END AS province, ts, event_id FROM events""",
}
_NEEDS = {"listing": ["places"], "building": ["places"]}


def with_views(views: str, body: str, **more: str) -> str:
    """SQL text with the named common table expressions (and what they need) in front of the body."""
    names: list[str] = []
    for name in views.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in names:
                names.append(needed)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)}{'' if body.startswith(',') else ' '}{body}"
