"""Ordered computations that do not depend on how rows spread over keys.

A plain window puts all rows of a key into one task. These helpers cut every key into slices, work inside the slices
and carry one row per slice across, so a key that holds a large share of all rows still spreads over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelake.session import settled


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], slice_by: Column, name: str = "previous"
) -> DataFrame:
    """Adds the struct ``name`` of the key's preceding row's ``values`` (null on a key's first row).

    ``slice_by`` must not decrease along ``order``; a day or an hour of the ordering time does.
    """
    sliced = df.withColumn("_slice", slice_by)
    local = W.partitionBy(*keys, "_slice").orderBy(*order)
    rows = sliced.withColumns(
        {"_before": F.lag(F.struct(*values)).over(local), "_first": F.row_number().over(local) == 1}
    )
    tails = sliced.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys, "_slice", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_slice")).alias("_carried")
    )
    same = F.lit(True)
    for c in [*keys, "_slice"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    return rows.alias("r").join(carried.alias("t"), same, "left").select(
        *[F.col(f"r.{c}").alias(c) for c in df.columns],
        F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")).alias(name),
    )


def _rows_before(counts: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys, _bucket, _offset): the rows in the buckets before each one.

    The counts are cut into ``parts`` consecutive groups of buckets. Running totals inside the groups and one over the
    groups' sums add up to the offset, so no task sees one row per bucket of a key. Which group a bucket fell into is
    stored, since both totals have to agree on it.
    """
    so_far = (W.unboundedPreceding, -1)
    before = lambda by: F.coalesce(F.sum("count").over(by.rowsBetween(*so_far)), F.lit(0))
    if parts == 1:
        return counts.select(*keys, "_bucket", before(W.partitionBy(*keys).orderBy("_bucket")).alias("_offset"))
    ranges = counts.repartitionByRange(parts, *keys, "_bucket").withColumn("_part", F.spark_partition_id())
    placed = settled(ranges)
    inside = placed.withColumn("_inside", before(W.partitionBy(*keys, "_part").orderBy("_bucket")))
    sums = placed.groupBy(*keys, "_part").agg(F.sum("count").alias("count"))
    groups = sums.withColumn("_groups", before(W.partitionBy(*keys).orderBy("_part")))
    joined = inside.alias("i").join(groups.alias("g"), _same("i", "g", [*keys, "_part"]))
    return joined.select(
        *[F.col(f"i.{c}").alias(c) for c in [*keys, "_bucket"]], (F.col("_inside") + F.col("_groups")).alias("_offset")
    )


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Null keys and buckets are keys and buckets like any other."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def _orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]


def numbered(
    df: DataFrame, bucket: Column, order: list[str | Column], name: str = "position", keys: list[str] = [],
    parts: int | None = None,
) -> DataFrame:
    """Adds a gapless 1-based ``name`` over all rows (of each key, with ``keys``), ordered by ``bucket`` and then by
    ``order``. All other columns that have an order break ties, so a rerun numbers alike.

    Rows are numbered inside their bucket, and the counts of the buckets are summed up in ``parts`` groups (as many as
    shuffle partitions unless given; 1 where the caller knows that buckets are few). A bucket that does not decrease
    along ``order`` gives the whole order, a hashed one gives plain unique numbers.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_bucket", bucket)
    offsets = _rows_before(rows.groupBy(*keys, "_bucket").count(), keys, parts)
    named = {*keys, *[c for c in order if isinstance(c, str)]}
    ties = [c for c in _orderable(df) if c not in named]
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order, *ties))
    ranked = rows.withColumn("_inside", inside)
    return ranked.alias("r").join(offsets.alias("o"), _same("r", "o", [*keys, "_bucket"])).select(
        *[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("_offset") + F.col("_inside")).cast("long").alias(name)
    )


def with_new_ids(new: DataFrame, stored: DataFrame, key: str, buckets: int = 8192, highest: int | None = None) -> DataFrame:
    """Gives new rows surrogate ids above the stored ones (or above ``highest``, where the caller knows it). The ids depend on the
    keys only, so a retry repeats them."""
    base = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar() if highest is None else F.lit(highest)
    rows = numbered(new, F.pmod(F.xxhash64(key), F.lit(buckets)), [key], "_n", parts=1)
    return rows.withColumn("id", (base + F.col("_n")).cast("long")).drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``. Spark keeps one row per key and task before it shuffles."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
