"""Pages of a table stored in one order."""

import re

from pyspark.sql import functions as F

from estatelake.sources import paged

ORDER = ["price", "id"]


def test_deep_page_reads_few_ranges(spark, tmp_path):
    """A third of all rows has one price and some have none; the page comes from at most three of 40 ranges."""
    n = 150_000
    price = F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") * 7919 % 1000)
    df = spark.range(n).select("id", price.cast("long").alias("price"))
    path = str(tmp_path / "t")
    paged.write_in_order(df, path, ORDER, 40)
    want = df.orderBy(*ORDER).offset(9_999 * 12).limit(12).collect()
    page = paged.read_page(spark, path, ORDER, 10_000, 12)
    assert page.collect() == want
    assert len(paged.ranges_of_page(spark, path, 10_000, 12)) <= 3
    assert re.search(r"PartitionFilters: \[[^\]]*_range#\d+ = \d+", page._jdf.queryExecution().toString())
    assert paged.read_page(spark, path, ORDER, 0, 12).collect() == df.orderBy(*ORDER).limit(12).collect()
    assert [r.id for r in paged.read_page(spark, path, ORDER, n // 1000 + 1, 1000).collect()] == []


def test_page_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    paged.write_in_order(spark.range(0).withColumn("price", F.lit(1)), path, ORDER, 4)
    assert paged.ranges_of_page(spark, path, 1, 10) == []
    assert paged.read_page(spark, path, ORDER, 1, 10).collect() == []
