"""Pages of listings, price history and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelake.fixed_values import BUILDINGS_PER_PAGE, LISTINGS_PER_PAGE, PROPOSALS_PER_PAGE, UNITS_PER_BUILDING
from estatelake.operators.ordered import numbered, with_previous


def _page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordering. Spark keeps page·size rows per task at most, so this is for pages people turn to."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def listing_page(df: DataFrame, sort: str = "price_asc", page: int = 1, size: int = LISTINGS_PER_PAGE) -> DataFrame:
    """A page of listings by price; the id breaks ties."""
    price = F.desc("price") if sort == "price_desc" else F.asc("price")
    return _page(df, [price, F.asc("id")], page, size)


def recent(df: DataFrame, by: str, page: int = 1, size: int = BUILDINGS_PER_PAGE) -> DataFrame:
    """Newest first; the id breaks ties."""
    return _page(df, [F.desc(by), F.asc("id")], page, size)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), F.desc("id")).limit(1)


def first_lines(lines: DataFrame, n: int | None) -> DataFrame:
    """The first lines by id for a sample run, or all of them."""
    return lines.orderBy("id").limit(n) if n else lines


def proposal_page(df: DataFrame, page: int | None, size: int = PROPOSALS_PER_PAGE) -> DataFrame:
    """A page of proposals, changed ones first. The asked page is moved into the pages that exist, which is decided by
    Spark from the count: rows outside the page drop out before anything is ordered beyond the page's end."""
    asked = page if isinstance(page, int) and not isinstance(page, bool) else 1
    total = df.agg(F.count("*")).scalar()
    last = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    current = F.least(F.greatest(F.lit(asked).cast("long"), F.lit(1).cast("long")), last)
    # Positions come from one count per (changed, id bucket) and numbering inside it.
    bucket = F.struct((~F.col("changed")).alias("same"), F.floor(F.col("id") / 100_000).alias("ids"))
    rows = numbered(df, bucket, ["id"], "position")
    start = (current - 1) * size
    return rows.where((F.col("position") > start) & (F.col("position") <= start + size)).orderBy("position")


def proposal_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if("changed").alias("changed_total"))


def cheapest_units(units: DataFrame, n: int = UNITS_PER_BUILDING, ties: list[str] = ["id"]) -> DataFrame:
    """The n cheapest units of every building. Each task keeps n rows per building before the shuffle, so a building
    with very many units costs no more than others."""
    rank = F.row_number().over(W.partitionBy("building_id").orderBy("rent", *ties))
    return units.withColumn("rank", rank).where(F.col("rank") <= n)


def price_cuts(history: DataFrame, key: str = "property_id", ties: list[str] = ["price"]) -> DataFrame:
    """Latest price, the one before and the cut between them (0 when the price did not fall) per listing."""
    newest = W.partitionBy(key).orderBy(F.desc("recorded_at"), *[F.desc(t) for t in ties])
    two = history.select(key, "price", "recorded_at", F.row_number().over(newest).alias("_n")).where("_n <= 2")
    points = two.groupBy(key).agg(
        F.max(F.when(F.col("_n") == 1, F.col("price"))).alias("latest"),
        F.max(F.when(F.col("_n") == 2, F.col("price"))).alias("previous"),
    )
    fall = F.col("previous") - F.col("latest")
    return points.withColumn("cut", F.when(fall > 0, fall).otherwise(F.lit(0).cast("long")))


def price_summary(history: DataFrame, key: str = "property_id") -> DataFrame:
    return history.groupBy(key).agg(
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
        (F.max("price") - F.min("price")).alias("spread"),
        F.count("*").alias("points"),
    )


def detect_changes(
    snapshots: DataFrame, key: str | list[str], order: list[str], values: list[str], slice_by: Column, first: bool = False
) -> DataFrame:
    """Rows where the values differ from the key's preceding row. ``first`` also reports a key's first row.

    Texts compare with null as empty, so a value stored as null and read again as '' is no change.
    """
    keys = [key] if isinstance(key, str) else key
    texts = {n for n, t in snapshots.dtypes if t == "string"}
    rows = with_previous(snapshots, keys, order, values, slice_by)
    same = F.lit(True)
    for v in values:
        now, before = F.col(v), F.col(f"previous.{v}")
        if v in texts:
            now, before = F.coalesce(now, F.lit("")), F.coalesce(before, F.lit(""))
        same = same & now.eqNullSafe(before)
    changed = F.col("previous").isNotNull() & ~same
    return rows.where(changed | F.col("previous").isNull() if first else changed)


def with_children(
    parent: DataFrame, child: DataFrame, key: str, order: list[Column], slice_by: Column, child_key: str | None = None
) -> DataFrame:
    """Each parent row with its children, one row per child in ``order`` (``child_no`` from 1; one row with nulls for a
    parent without children). The children stay rows, and ``slice_by`` (which follows ``order``) cuts the numbering of a
    parent with very many of them into slices.

    A child list is read for one parent or one page of parents at a time, so narrow ``parent`` first.
    """
    child_key = child_key or key
    mine = child.join(parent.select(F.col(key).alias(child_key)).distinct(), child_key, "left_semi")
    listed = numbered(mine, slice_by, order, "child_no", [child_key], parts=1)
    return parent.join(listed, parent[key] == listed[child_key], "left").drop(listed[child_key])
