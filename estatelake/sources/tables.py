"""Stored tables as Parquet and the schema changes between versions.

Tables that are written whole have one directory per version. Tables that micro-batches keep up to date have one directory per
hash bucket, and a batch overwrites the buckets it meets (Spark's dynamic partition overwrite); all other files stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatelake.schemas import BUCKET_KEYS, CLUSTERING, PARTITIONS, TABLES


def _schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Complete versions of a table, oldest first. A version counts once Spark has written its success marker."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(f"{root}/{name}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = []
    for status in fs.listStatus(base):
        folder = status.getPath().getName()
        if folder.startswith("v=") and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            found.append(int(folder[2:]))
    return sorted(found)


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The given version, or the newest; for a table in buckets its present rows. A table never written reads as empty."""
    known = versions(spark, root, name)
    if not known and name in BUCKET_KEYS:
        return read_buckets(spark, root, name).drop("bucket")
    if version is None:
        version = known[-1] if known else None
    if version is None:
        return spark.createDataFrame([], _schema(name))
    return spark.read.schema(_schema(name)).parquet(f"{root}/{name}/v={version}")


def write_table(df: DataFrame, root: str, name: str, version: int) -> None:
    """Writes one version whole. Writing the same version again replaces it, so a retried job leaves one result.

    Rows are rebalanced by partition before the write: adaptive execution gives a large partition several files and
    packs small ones together, whatever the job's own parallelism was.
    """
    out = conform(df, name)
    parts, order = PARTITIONS.get(name, []), CLUSTERING.get(name, [])
    if parts:
        out = out.hint("rebalance", *parts)
    if parts or order:
        out = out.sortWithinPartitions(*parts, *order)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(f"{root}/{name}/v={version}")


def append_log(df: DataFrame, root: str, name: str, batch: int) -> None:
    """Appends one batch to an append-only table. A replayed batch replaces its own rows only."""
    conform(df, name).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{root}/{name}/batch={batch}"
    )


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(f"{root}/{name}")
    if not base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base):
        return spark.createDataFrame([], _schema(name))
    return spark.read.schema(_schema(name).add("batch", "long")).parquet(f"{root}/{name}").drop("batch")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def bucket_of(name: str, buckets: int) -> Column:
    """Bucket of a row of a table."""
    key = BUCKET_KEYS[name]
    return (F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0)).alias("bucket")


def read_buckets(spark: SparkSession, root: str, name: str, only: list[int] | None = None) -> DataFrame:
    """Rows of a table in buckets, with their ``bucket``; ``only`` some buckets, whose directories alone are read then."""
    schema = _schema(name).add("bucket", "integer")
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/{name}")
    return rows if only is None else rows.where(F.col("bucket").isin(only))


def write_buckets(df: DataFrame, root: str, name: str) -> None:
    """Replaces the buckets (column ``bucket``) that ``df`` has rows of, as whole buckets. Others keep their files. Writing the same
    rows again gives the same table."""
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(name).fields], "bucket")
    out = out.hint("rebalance", "bucket").sortWithinPartitions("bucket", *PARTITIONS.get(name, []), *CLUSTERING.get(name, []))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Brings rows of an older layout to the table's schema: adds columns (with a default), drops unknown ones, casts
    the rest (so text dates become dates and timestamps)."""
    defaults = defaults or {}
    columns: list[Column] = []
    for field in _schema(name).fields:
        if field.name in df.columns:
            value = F.col(field.name)
            if field.name in defaults:
                value = F.coalesce(value, F.lit(defaults[field.name]))
        else:
            value = F.lit(defaults.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def import_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Reads a relational table in parallel key ranges, for moving stored rows over once."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
