"""Dimension tables: listing types, regions and prefectures. At most 47 rows each, so they always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.fixed_values import LISTING_TYPES, PREFECTURES_JA, REGIONS, RENTAL_TYPE, UNIT_TYPES


def listing_types(spark: SparkSession) -> DataFrame:
    rows = [
        (ord_, type_id, name, name_ja, type_id == RENTAL_TYPE, type_id in UNIT_TYPES)
        for ord_, (type_id, name, name_ja) in enumerate(LISTING_TYPES)
    ]
    return spark.createDataFrame(
        rows, "ord int, type string, type_name string, type_name_ja string, is_rental boolean, is_unit boolean"
    )


def prefectures(spark: SparkSession) -> DataFrame:
    """One row per prefecture with its region, in retrieval order (``ord``) and with its JIS code (``province``)."""
    rows = []
    for region_ord, (region, region_name, first, names) in enumerate(REGIONS):
        for offset, name in enumerate(names):
            code = first + offset
            rows.append((region_ord * 100 + offset, region, region_name, f"{code:02d}", name, PREFECTURES_JA[code - 1]))
    return spark.createDataFrame(
        rows,
        "ord int, region string, region_name string, province string, province_name string, prefecture string",
    )


def prefecture_list(spark: SparkSession) -> DataFrame:
    """The flat list shown for picking a prefecture, by code."""
    return prefectures(spark).select("province", "province_name", "region").orderBy("province")


def regions(spark: SparkSession) -> DataFrame:
    return prefectures(spark).groupBy("region", "region_name").agg(F.count("*").alias("provinces"))
