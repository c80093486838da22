"""Row filters of the listing and rental searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import (
    BUILDING_KEY_PREFIX, DETAIL_MAX_AGE_SECONDS, FAILED_RETRY_SECONDS, PRICE_BANDS, SIZE_MINIMUMS, TYPED_DETAIL_LABELS,
    WALK_MAXIMUMS,
)
from estatelake.functions.text import filled


def listing_condition(price: str = "any", size: str = "any", walk: str = "any") -> Column:
    """The search's price, size and walk options as one predicate. Option values nobody offers count as ``any``."""
    low, high = PRICE_BANDS.get(price, (None, None))
    smallest = SIZE_MINIMUMS.get(size, 0)
    farthest = WALK_MAXIMUMS.get(walk, 0)
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col("price") >= low)
    if high is not None:
        condition = condition & (F.col("price") < high)
    if smallest:
        # A building area of 0 is unknown; the land figure stands in for it.
        condition = condition & (
            (F.col("building_area") >= smallest) | ((F.col("building_area") == 0) & (F.col("area") >= smallest))
        )
    if farthest:
        condition = condition & (F.col("walking_minutes") > 0) & (F.col("walking_minutes") <= farthest)
    return condition


def has_active_filters(price: str = "any", size: str = "any", walk: str = "any") -> bool:
    return (
        PRICE_BANDS.get(price, (None, None)) != (None, None)
        or SIZE_MINIMUMS.get(size, 0) > 0
        or WALK_MAXIMUMS.get(walk, 0) > 0
    )


def in_scope(df: DataFrame, **scope: str) -> DataFrame:
    """Equality on the partition columns (section_type, region, province), so a search reads only its directories."""
    for column, value in scope.items():
        df = df.where(F.col(column) == value)
    return df


def within(df: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Equality on those columns of the scope that the rows carry; rows that carry none stay whole."""
    return in_scope(df, **{c: v for c, v in scope.items() if c in df.columns})


def filter_listings(
    df: DataFrame, scope: dict[str, str], price: str = "any", size: str = "any", walk: str = "any"
) -> DataFrame:
    return in_scope(df, **scope).where(listing_condition(price, size, walk))


def filter_units(df: DataFrame, min_rent: int | None = None, max_rent: int | None = None) -> DataFrame:
    """Rent bounds, both inclusive. No bound and a bound of 0 are the same."""
    if min_rent:
        df = df.where(F.col("rent") >= min_rent)
    if max_rent:
        df = df.where(F.col("rent") <= max_rent)
    return df


def needs_translation(df: DataFrame) -> DataFrame:
    def missing(source: str, target: str) -> Column:
        return filled(F.col(source)).isNotNull() & filled(F.col(target)).isNull()

    return df.where(missing("property_name", "translated_property_name") | missing("title", "translated_title"))


def due_for_refresh(listings: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Listings whose details are a week old or were never read, without a pending or freshly failed request."""
    state = requests.select(F.col("property_id").alias("id"), "status", "requested_at")
    rows = listings.join(state, "id", "left")
    age = lambda c: F.timestamp_diff("SECOND", F.col(c), as_of)
    fresh = F.col("detail_fetched_at").isNotNull() & (age("detail_fetched_at") < DETAIL_MAX_AGE_SECONDS)
    pending = F.col("status").isin("queued", "running")
    failed = (F.col("status") == "failed") & F.col("requested_at").isNotNull() & (age("requested_at") < FAILED_RETRY_SECONDS)
    blocked = F.coalesce(fresh, F.lit(False)) | F.coalesce(pending, F.lit(False)) | F.coalesce(failed, F.lit(False))
    return rows.where(~blocked).select(*listings.columns)


def legacy_buildings(df: DataFrame) -> DataFrame:
    """Buildings stored under one of their units' ids instead of a building key."""
    return df.where(~F.startswith("source_id", F.lit(BUILDING_KEY_PREFIX)))


def keyed_buildings(df: DataFrame, key: str = "building_key") -> DataFrame:
    """Leaves out listed buildings whose page gave no id."""
    return df.where(F.col(key) != BUILDING_KEY_PREFIX)


def extra_facts(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("label").isin(TYPED_DETAIL_LABELS))


def changed_only(proposals: DataFrame) -> DataFrame:
    return proposals.where("changed")


def get_by_id(df: DataFrame, id: int) -> DataFrame:
    return df.where(F.col("id") == id)
