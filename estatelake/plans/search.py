"""The two searches: a page of sale listings with price cuts, and a page of rental buildings with their units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.fixed_values import BUILDINGS_PER_PAGE, LISTINGS_PER_PAGE
from estatelake.functions.measures import unit_price
from estatelake.operators import counts, filters, listings, rentals
from estatelake.sources import families


def listing_search(
    listing: DataFrame, history: DataFrame, scope: dict[str, str], sort: str = "price_asc", page: int = 1, **options: str
) -> DataFrame:
    """One page of listings with their last price cut and unit price. Only the page's listings look up their history; a history
    stored with its listings (``families``) is read in the search's area only."""
    rows = listings.listing_page(filters.filter_listings(listing, scope, **options), sort, page)
    history = filters.within(history, scope)
    mine = history.join(rows.select(F.col("id").alias("property_id")), "property_id", "left_semi")
    cuts = listings.price_cuts(mine).select(F.col("property_id").alias("id"), "cut")
    priced = rows.join(cuts, "id", "left").withColumns(
        {
            "cut": F.coalesce("cut", F.lit(0).cast("long")),
            "unit_price": unit_price(F.col("price"), F.col("building_area"), F.col("area")),
        }
    )
    return priced.orderBy(F.desc("price") if sort == "price_desc" else F.asc("price"), "id")


def stored_rental_units(
    spark: SparkSession, root: str, scope: dict[str, str], page: int = 1, min_rent: int | None = None, max_rent: int | None = None,
) -> DataFrame:
    """Units within the rent bounds of one page of buildings, all read from a stored family: the area picks the directories, the
    page's buildings the files in them."""
    building, unit = (filters.in_scope(families.read_family(spark, root, n), **scope) for n in ("parents", "units"))
    matching = filters.filter_units(unit, min_rent, max_rent)
    shown = rentals.rental_page(building, unit, page, BUILDINGS_PER_PAGE, min_rent, max_rent)
    return families.children_of(matching, "building_id", shown)


def listing_total(listing: DataFrame, scope: dict[str, str], **options: str) -> DataFrame:
    return counts.count_pages(filters.filter_listings(listing, scope, **options), LISTINGS_PER_PAGE)


@dataclass
class RentalSearch:
    """The parts of a rental search page, each its own query over the same narrowed buildings. Units and links that carry the
    area of their building (``families``) are narrowed to the search's area before anything else."""

    buildings: DataFrame
    units: DataFrame
    stops: DataFrame
    lines: DataFrame
    stations: DataFrame
    building_total: DataFrame
    unit_total: DataFrame


def rental_search(
    tables: dict[str, DataFrame], scope: dict[str, str], page: int = 1, line_id: int | None = None,
    station_id: int | None = None, min_rent: int | None = None, max_rent: int | None = None,
) -> RentalSearch:
    building, unit, line, station, link = (
        tables[n] for n in ("building", "rental_unit", "train_line", "station", "building_station")
    )
    area = filters.in_scope(building, **scope)
    unit, link = filters.within(unit, scope), filters.within(link, scope)
    chosen = rentals.filter_buildings(area, link, station, station_id, line_id)
    matching = filters.filter_units(unit, min_rent, max_rent)
    found = rentals.buildings_with_units(chosen, matching)
    shown = listings.recent(found, "last_updated", page, BUILDINGS_PER_PAGE)
    ids = shown.select(F.col("id").alias("building_id"))
    return RentalSearch(
        buildings=shown,
        units=listings.cheapest_units(matching.join(ids, "building_id", "left_semi")),
        stops=rentals.with_stations(shown.select("id"), link.join(ids, "building_id", "left_semi"), station, line),
        lines=rentals.line_facet(line, station, link, area),
        stations=rentals.stations_in_area(station, link, area, line_id),
        building_total=counts.count_pages(found, BUILDINGS_PER_PAGE),
        unit_total=rentals.count_units(matching, chosen),
    )
