"""Parents with their children (buildings with units and station links, listings with price history), stored by area.

A child row carries the area columns of its parent, so a search's area reaches the scan of the children as a partition filter,
and only that area's rows are aggregated and shuffled. Inside an area the rows lie in order of the parent, in files that each
hold a narrow range of parents, so the children of a page of parents come from the few files and row groups that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA = ["region", "province"]


def _write(df: DataFrame, path: str, key: str, area: list[str], ranges: int) -> None:
    """Rows in ranges of (area, key). A hash of the row ends the order, so one parent's very many rows spread over files."""
    order = [*area, key, F.xxhash64(*df.columns)]
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy(*area).parquet(f"{path}/rows")
    # Areas are texts such as 030, which reading directory names would turn into numbers.
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def write_family(
    root: str, parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "id", area: list[str] = AREA, ranges: int = 64,
) -> None:
    """Stores ``parents`` and, by name, each table of ``children`` (rows and the column that holds the parent's key).

    Parents' keys are unique. Children without a parent (or without a key) and parents without an area lie in the area null,
    which no search meets; an empty area text counts as null. Area columns that a child table has already are replaced.
    """
    _write(parents, f"{root}/parents", key, area, ranges)
    placed = parents.where(F.col(key).isNotNull())
    for name, (rows, parent) in children.items():
        own = rows.drop(*area)
        areas = placed.select(F.col(key).alias("__parent"), *area)
        out = own.join(areas, F.col(parent) == F.col("__parent"), "left").drop("__parent")
        _write(out, f"{root}/{name}", parent, area, ranges)


def read_family(spark: SparkSession, root: str, name: str = "parents") -> DataFrame:
    """The parents, or the children of a name, with their area columns."""
    return spark.read.schema(spark.read.parquet(f"{root}/{name}/columns").schema).parquet(f"{root}/{name}/rows")


def children_of(children: DataFrame, parent: str, page: DataFrame, key: str = "id") -> DataFrame:
    """Children of one page of parents. The page's keys (no more than the page has rows) become values of the scan, where the
    statistics of files and row groups leave out all others."""
    ids = [r[0] for r in page.select(key).where(F.col(key).isNotNull()).distinct().collect()]
    return children.where(F.col(parent).isin(ids)) if ids else children.where(F.lit(False))
