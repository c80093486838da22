"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.session import stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that ended. It does so when the driver collects its garbage, which may not
    happen for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Removes the folders of ``stored`` tables, also those behind a plan made of them, that nothing reads any more."""
    spark = tables[0].sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {file.rpartition("/")[0] for table in tables for file in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("stored-"):
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def digest(texts: Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(F.encode(texts, "UTF-8"), 256)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
