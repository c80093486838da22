"""Scale fixture: buildings, units and listings spread over all prefectures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.functions.places import region_of
from estatelake.sources.tables import conform


def _code(n: Column) -> Column:
    return F.lpad((n % 47 + 1).cast("string"), 2, "0")


def make_fixture(
    spark: SparkSession, n_buildings: int = 40_000, n_units: int = 300_000, n_listings: int = 300_000
) -> dict[str, DataFrame]:
    stamp = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    n = F.col("n")
    buildings = spark.range(1, n_buildings + 1).toDF("n").select(
        n.alias("id"), F.concat(F.lit("building-"), n).alias("source_id"), _code(n).alias("province"),
        region_of(_code(n)).alias("region"), stamp.alias("insert_date"), stamp.alias("last_updated"),
    )
    units = spark.range(n_units).toDF("n").select(
        (n + 1).alias("id"), F.concat(F.lit("unit-"), n).alias("source_id"), (n % n_buildings + 1).alias("building_id"),
        (n + 50_000).alias("rent"), stamp.alias("insert_date"), stamp.alias("last_updated"),
    )
    listings = spark.range(n_listings).toDF("n").select(
        (n + 1).alias("id"), F.concat(F.lit("listing-"), n).alias("source_id"), (n + 1_000).alias("price"),
        F.lit("021").alias("section_type"), _code(n).alias("province"), region_of(_code(n)).alias("region"),
        stamp.alias("last_updated"),
    )
    return {
        "building": conform(buildings, "building"),
        "rental_unit": conform(units, "rental_unit"),
        "listing": conform(listings, "listing"),
    }
