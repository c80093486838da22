"""Tables stored in one order, whose pages are read from the files that hold them, however deep the page lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_in_order(df: DataFrame, path: str, order: list[str | Column], ranges: int) -> None:
    """Stores the rows in ``ranges`` consecutive ranges of ``order``, and beside them how many rows lie before each range.

    ``order`` has to tell all rows apart (end it with the id), so that equal values spread over ranges as well. Rows are
    cut by Spark's sampled range boundaries; the side table has one row per range that is not empty, whatever the corpus.
    """
    cut = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    cut.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    # Without rows there is no file in ``rows`` to take the columns from.
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    held = _rows(df.sparkSession, path).groupBy("_range").agg(F.count("*").alias("held"))
    before = F.sum("held").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    held.withColumn("before", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").withColumn("_range", F.lit(0)).schema
    return spark.read.schema(columns).parquet(f"{path}/rows")


def ranges_of_page(spark: SparkSession, path: str, page: int, size: int) -> list[tuple[int, int]]:
    """(range, rows before it) of the ranges that hold the page; no more than ``size`` of them."""
    start = (max(page, 1) - 1) * size
    meets = (F.col("before") < start + size) & (F.col("before") + F.col("held") > start)
    found = spark.read.parquet(f"{path}/ranges").where(meets).select("_range", "before").orderBy("before")
    return [tuple(r) for r in found.collect()]


def read_page(spark: SparkSession, path: str, order: list[str | Column], page: int, size: int) -> DataFrame:
    """The page of a table stored in ``order``, pages from 1. A page beyond the end is empty.

    Only the ranges that hold the page are read and ordered, so page 100,000 costs what page 1 costs.
    """
    found = ranges_of_page(spark, path, page, size)
    rows = _rows(spark, path)
    start = (max(page, 1) - 1) * size - (found[0][1] if found else 0)
    held = rows.where(F.col("_range").isin([r for r, _ in found])) if found else rows.where(F.lit(False))
    return held.drop("_range").orderBy(*order).offset(start if found else 0).limit(size)
