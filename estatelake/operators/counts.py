"""Counts per area, type, line and run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.functions.labels import percent_of
from estatelake.functions.places import prefecture_code, region_of


def buy_counts(listings: DataFrame, section_type: str) -> DataFrame:
    """Listings of one type per (region, province)."""
    return (
        listings.where(F.col("section_type") == section_type)
        .groupBy("region", "province")
        .agg(F.count("*").alias("listings"))
    )


def rental_counts(units: DataFrame, buildings: DataFrame) -> DataFrame:
    """Units per (region, province) of their building. Units are counted per building first, so the join carries one
    row per building however many units it has."""
    per_building = units.groupBy("building_id").agg(F.count("*").alias("units"))
    return (
        per_building.join(buildings.select(F.col("id").alias("building_id"), "region", "province"), "building_id")
        .groupBy("region", "province")
        .agg(F.sum("units").alias("listings"))
    )


def listing_totals(listings: DataFrame, units: DataFrame, rental_type: str = "040") -> DataFrame:
    """Listings per type (rows without a type left out) plus one row with the number of rental units."""
    sale = listings.where(F.col("section_type").isNotNull()).groupBy("section_type").agg(F.count("*").alias("listings"))
    rental = units.agg(F.count("*").alias("listings")).select(F.lit(rental_type).alias("section_type"), "listings")
    return sale.unionByName(rental)


def as_nested(counts: DataFrame) -> DataFrame:
    """One row per region with its map province → count. Takes aggregated counts, at most 47 provinces."""
    return counts.groupBy("region").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("province", "listings")))).alias("provinces")
    )


def area_rollup(counts: DataFrame) -> DataFrame:
    """Counts per province, per region (province null) and in total (both null)."""
    return counts.rollup("region", "province").agg(F.sum("listings").alias("listings"))


def area_table(areas: DataFrame, counts: DataFrame) -> DataFrame:
    """Every area of the dimension with its count (0 where none), its region's total and its bar length in percent of
    the largest province."""
    known = counts.groupBy("province").agg(F.sum("listings").alias("listings"))
    totals = counts.groupBy("region").agg(F.sum("listings").alias("region_total"))
    highest = known.agg(F.coalesce(F.max("listings"), F.lit(0))).scalar()
    rows = areas.join(known, "province", "left").join(totals, "region", "left")
    listings = F.coalesce("listings", F.lit(0))
    return rows.withColumns(
        {
            "listings": listings,
            "region_total": F.coalesce("region_total", F.lit(0)),
            "percent": percent_of(listings, highest),
        }
    )


def count_pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Totals of runs by outcome and the share of completed ones in percent, in one pass."""
    share = F.floor(F.col("completed") * 100 / F.col("total") + F.lit(0.5)).cast("long")
    return runs.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "cancelled")],
    ).withColumn("success_rate", F.when(F.col("total") > 0, share).otherwise(F.lit(0).cast("long")))


def locate(df: DataFrame, state: str = "state") -> DataFrame:
    """Region and province from the address's prefecture; the section's own where the prefecture is not known."""
    code = prefecture_code(F.col(state))
    return df.withColumns(
        {"region": F.coalesce(region_of(code), F.col("region")), "province": F.coalesce(code, F.col("province"))}
    )


def location_transitions(df: DataFrame) -> DataFrame:
    """How many rows the located region/province would change, per (old, new, prefecture), most frequent first."""
    code = prefecture_code(F.col("state"))
    moved = df.where(code.isNotNull()).select(
        "state", F.col("region").alias("old_region"), F.col("province").alias("old_province"),
        region_of(code).alias("new_region"), code.alias("new_province"),
    )
    return transitions(moved)


def transitions(moved: DataFrame) -> DataFrame:
    """Counts (old → new, prefecture) pairs that differ; rows already in place do not count."""
    same = F.col("old_region").eqNullSafe(F.col("new_region")) & F.col("old_province").eqNullSafe(F.col("new_province"))
    keys = ["old_region", "old_province", "new_region", "new_province", "state"]
    return moved.where(~same).groupBy(*keys).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *keys)


def location_totals(df: DataFrame) -> DataFrame:
    """Rows scanned, rows whose location would change and rows without a known prefecture."""
    code = prefecture_code(F.col("state"))
    region = region_of(code)
    moved = code.isNotNull() & ~(F.col("region").eqNullSafe(region) & F.col("province").eqNullSafe(code))
    return df.agg(
        F.count("*").alias("scanned"), F.count_if(moved).alias("changed"), F.count_if(code.isNull()).alias("unresolved")
    )


def backfill_location(df: DataFrame) -> DataFrame:
    """The table with every known prefecture's region and province; other rows are left alone."""
    return locate(df)


def relabel_types(df: DataFrame, types: DataFrame) -> DataFrame:
    """Type name from the section a listing was found in; rows without a known section keep theirs."""
    names = types.select(F.col("type").alias("section_type"), F.col("type_name_ja").alias("_name"))
    return df.join(names, "section_type", "left").select(
        *[F.coalesce("_name", c).alias(c) if c == "property_type" else F.col(c) for c in df.columns]
    )


def refresh_counts(listings: DataFrame, units: DataFrame, buildings: DataFrame) -> DataFrame:
    """All stored counts in one table: (counts, section_type, region, province, listings). Rental counts come from the
    units, all others from the listings in one pass."""
    sale = (
        listings.where(F.col("section_type").isNotNull())
        .groupBy("section_type", "region", "province")
        .agg(F.count("*").alias("listings"))
    )
    rental = rental_counts(units, buildings).select(F.lit("040").alias("section_type"), "region", "province", "listings")
    return sale.unionByName(rental)


def count_changes(changes: DataFrame) -> DataFrame:
    """What written rows (structs ``before`` and ``after``, either null) change the counts per type and area by: one less where the row
    was, one more where it is. Rows without a type count nowhere."""
    area = lambda side, by: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("section_type", "region", "province")], F.lit(by).alias("by"))
    both = changes.select(F.explode(F.array(area("before", -1), area("after", 1))).alias("c")).select("c.*")
    known = both.where(F.col("section_type").isNotNull())
    moved = known.groupBy("section_type", "region", "province").agg(F.sum("by").cast("long").alias("listings"))
    return moved.where("listings <> 0")


def with_changes(stored: DataFrame, moved: DataFrame) -> DataFrame:
    """Stored counts after changes to them. An area whose last row is gone stays with 0."""
    keys = ["section_type", "region", "province"]
    return stored.select(*keys, "listings").unionByName(moved.select(*keys, "listings")).groupBy(*keys).agg(F.sum("listings").alias("listings"))
