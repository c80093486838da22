"""Pages of a crawl to the next snapshot of every stored table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import RENTAL_TYPE
from estatelake.functions.records import stations_from_json
from estatelake.operators import cards, upserts
from estatelake.operators.counts import count_changes, locate
from estatelake.operators.filters import keyed_buildings
from estatelake.session import settled
from estatelake.sources.dims import listing_types


@dataclass
class Ingest:
    """Next tables and history rows by name, and every row of the pages with the status it counts as: a listing met again on
    a later page compares with what the page before said; rows of buildings without a key have no status but are items; a
    page without items has one row that is no item. ``changed`` names by their bucket keys the rows of each table that may differ from
    before, ``moved`` has what the counts per area change by."""

    tables: dict[str, DataFrame]
    logs: dict[str, DataFrame]
    classified: DataFrame
    changed: dict[str, DataFrame]
    moved: DataFrame


def _rejects(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("row"))


def with_section(pages: DataFrame) -> DataFrame:
    """The section a list page belongs to, read from its address: type, region, province and page number."""
    part = lambda key: F.regexp_extract("url", rf"[?&]{key}=([0-9]+)", 1)
    return pages.withColumns(
        {
            "section_type": part("bs"), "region": part("ar"), "province": part("ta"),
            "page": F.regexp_extract("url", r"[?&](?:pn|page)=([0-9]+)", 1).try_cast("int"),
        }
    ).withColumn("section_key", F.concat_ws("-", "region", "province", "section_type"))


def _on_pages(pages: DataFrame, met: DataFrame, sightings: DataFrame) -> DataFrame:
    """(source_id, section_key, page, item, metric_status) of every row met, and a row for each page that holds none."""
    status = sightings.where(F.col("source_id").isNotNull())
    rows = met.select("source_id", "section_key", "page", "page_id", "ordinal").join(status, ["source_id", "ordinal"], "left")
    listed = with_section(pages).select("page_id", "section_key", "page")
    items = rows.select("page_id", "section_key", "page", "source_id", F.lit(True).alias("item"), "metric_status")
    same = F.lit(True)
    for c in ("page_id", "section_key", "page"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"i.{c}"))
    joined = listed.alias("l").join(items.alias("i"), same, "left").select("l.*", "source_id", "item", "metric_status")
    return joined.select(
        "source_id", "section_key", "page", F.coalesce("item", F.lit(False)).alias("item"), "metric_status"
    )


_KEEP = ["page_id", "html", "section_type", "region", "province", "page", "section_key"]


def read_sale_pages(sale: DataFrame, project: DataFrame, origin: str) -> DataFrame:
    """Listings of for-sale and new-apartment pages in stored form, with the section's type and the place their address
    gives them (the section's own where it gives none). ``ordinal`` is the order in which they were met."""
    old = cards.type_sale_facts(cards.extract_sale_cards(with_section(sale).select(*_KEEP), origin))
    new = cards.extract_project_cards(with_section(project).select(*_KEEP), origin).drop("phases")
    rows = old.unionByName(new, allowMissingColumns=True)
    names = listing_types(rows.sparkSession).select(F.col("type").alias("section_type"), "type_name_ja")
    typed = locate(cards.normalise_listing(rows)).join(names, "section_type", "left")
    return typed.withColumn("property_type", F.coalesce("type_name_ja", F.lit(""))).withColumn(
        "ordinal", F.struct("page", "page_id", "ordinal")
    ).drop("type_name_ja")


def met_sales(
    sale: DataFrame, project: DataFrame, origin: str, as_of: Column, keep: Callable[[DataFrame], DataFrame] = settled
) -> DataFrame:
    """Listings of the pages. Parsing is the expensive part and several outputs need it, so its rows are written once."""
    return keep(read_sale_pages(sale, project, origin).withColumn("insert_date", F.to_date(as_of)))


def ingest_sales(
    listing: DataFrame, sale: DataFrame, project: DataFrame, origin: str, as_of: Column, met: DataFrame | None = None,
    highest: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Ingest:
    """``met`` are the pages' listings where the caller has read them already; ``listing`` may then be those stored rows alone whose
    keys can be met, with ``highest`` the highest id of the whole table, and of the pages only their id and address are read. ``keep`` is as
    in ``upsert_listings``."""
    met = met_sales(sale, project, origin, as_of) if met is None else met
    batch = met.select(*[c for c in listing.columns if c in met.columns], "ordinal")
    done = upserts.upsert_listings(listing, batch, as_of, highest=highest, keep=keep)
    pages = sale.select("page_id", "url").unionByName(project.select("page_id", "url"))
    classified = _on_pages(pages, met, done.sightings)
    return Ingest(
        {"listing": done.snapshot}, {"price_history": done.history, "row_reject": _rejects(done.rejected, "listing")}, classified,
        {"listing": done.changes.select("after.source_id")}, count_changes(done.changes),
    )


def met_rentals(pages: DataFrame, origin: str, keep: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """Units of the pages with their buildings, written once."""
    units = cards.extract_rental_units(with_section(pages).select(*_KEEP), origin)
    return keep(units.withColumn("ordinal", F.struct("page", "page_id", "building_ordinal", "unit_ordinal")))


def ingest_rentals(
    tables: dict[str, DataFrame], pages: DataFrame, origin: str, as_of: Column, met: DataFrame | None = None,
    highest: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Ingest:
    """Buildings, units, lines, stations and links of rental pages. Buildings still stored under a unit's id take their
    building key first, then the page's buildings and units are written. ``met``, ``highest`` and ``keep`` are as in ``ingest_sales``, with
    ``tables["rental_unit"]`` the units that can be met."""
    met = met_rentals(pages, origin) if met is None else met
    seen = upserts.first_seen_buildings(met, ["ordinal"])
    rekeyed = upserts.rekey_buildings(met, tables["rental_unit"], tables["building"])
    building = settled(upserts.upsert_buildings(rekeyed, seen, as_of))
    done = upserts.upsert_units(tables["rental_unit"], met, building, as_of, highest=highest, keep=keep)
    owners = building.select(F.col("id").alias("building_id"), F.col("source_id").alias("building_key"))
    stops = (
        keyed_buildings(met)
        .select("building_key", "region", "ordinal", F.posexplode("stations").alias("stop", "s"))
        .join(owners, "building_key")
        .select(
            "building_id", "s.line", "s.station", "s.walking_minutes", "region", F.struct("ordinal", "stop").alias("ordinal")
        )
    )
    transit = upserts.upsert_transit(stops, tables["train_line"], tables["station"], tables["building_station"], as_of)
    classified = _on_pages(pages.select("page_id", "url"), met, done.sightings)
    touched = building.join(seen.select("source_id"), "source_id", "left_semi").select("id")
    new = lambda name, after: after.select("id").join(tables[name].select("id"), "id", "left_anti")
    areas = building.select(F.col("id").alias("building_id"), "region", "province")
    inserted = done.changes.where(F.col("before").isNull()).select("after.building_id").join(areas, "building_id")
    moved = inserted.groupBy("region", "province").agg(F.count("*").alias("listings"))
    return Ingest(
        {
            "building": building, "rental_unit": done.snapshot, "train_line": transit.line, "station": transit.station,
            "building_station": transit.link,
        },
        {"rental_price_history": done.history, "row_reject": _rejects(done.rejected, "rental_unit")},
        classified,
        {
            "building": touched, "rental_unit": done.changes.select("after.source_id"), "train_line": new("train_line", transit.line),
            "station": new("station", transit.station), "building_station": touched.withColumnRenamed("id", "building_id"),
        },
        moved.select(F.lit(RENTAL_TYPE).alias("section_type"), "region", "province", "listings"),
    )


def stored_stations(buildings: DataFrame) -> DataFrame:
    """Buildings imported with their stations as JSON text, as typed stations."""
    return buildings.withColumn("stations", stations_from_json(F.col("stations")))
