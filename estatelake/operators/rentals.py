"""Rental search: buildings, their units, and the lines and stations that serve an area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import BUILDINGS_PER_PAGE
from estatelake.functions.text import first_filled
from estatelake.functions.transit import line_label
from estatelake.operators.filters import filter_units
from estatelake.operators.listings import recent


def _buildings_in(scope: DataFrame) -> DataFrame:
    return scope.select(F.col("id").alias("building_id"))


def buildings_per_line(links: DataFrame, stations: DataFrame, scope: DataFrame) -> DataFrame:
    """Distinct buildings of the area per line. (line, building) pairs are made distinct before they are counted, so a
    line with very many buildings is spread by building."""
    served = links.join(_buildings_in(scope), "building_id", "left_semi")
    lines = stations.select(F.col("id").alias("station_id"), "train_line_id")
    return served.join(lines, "station_id").groupBy("train_line_id").agg(F.count_distinct("building_id").alias("buildings"))


def served_stations(links: DataFrame, scope: DataFrame) -> DataFrame:
    """Ids of stations with a building in the area, each once."""
    return links.join(_buildings_in(scope), "building_id", "left_semi").select("station_id").distinct()


def lines_in_area(lines: DataFrame, stations: DataFrame, links: DataFrame, scope: DataFrame) -> DataFrame:
    served = stations.join(served_stations(links, scope).withColumnRenamed("station_id", "id"), "id", "left_semi")
    ids = served.select(F.col("train_line_id").alias("id")).distinct()
    return lines.join(ids, "id", "left_semi").orderBy("translated_name", "id")


def line_facet(lines: DataFrame, stations: DataFrame, links: DataFrame, scope: DataFrame) -> DataFrame:
    """Lines of the area with label, bus flag and number of buildings. One count gives both: a line belongs to the
    area exactly when it has a building there."""
    per_line = buildings_per_line(links, stations, scope).withColumnRenamed("train_line_id", "id")
    return (
        lines.join(per_line, "id")
        .select(
            "id",
            line_label(F.col("canonical_name"), F.col("translated_name"), F.col("name")).alias("label"),
            (F.col("kind") == "bus").alias("bus"),
            F.coalesce("buildings", F.lit(0)).alias("buildings"),
            "translated_name",
        )
        .orderBy("translated_name", "id")
        .drop("translated_name")
    )


def stations_in_area(stations: DataFrame, links: DataFrame, scope: DataFrame, line_id: int | None = None) -> DataFrame:
    """Stations (of one line) with a building in the area, by name."""
    chosen = stations if line_id is None else stations.where(F.col("train_line_id") == line_id)
    found = chosen.join(served_stations(links, scope).withColumnRenamed("station_id", "id"), "id", "left_semi")
    return found.select(
        "id", "train_line_id", "name", F.coalesce(first_filled(F.col("translated_name")), "name").alias("label")
    ).orderBy("name", "id")


def filter_buildings(
    scope: DataFrame, links: DataFrame, stations: DataFrame, station_id: int | None = None, line_id: int | None = None
) -> DataFrame:
    """Buildings near a station, else on a line, else all of the area."""
    if station_id:
        near = links.where(F.col("station_id") == station_id)
    elif line_id:
        on_line = stations.where(F.col("train_line_id") == line_id).select(F.col("id").alias("station_id"))
        near = links.join(on_line, "station_id", "left_semi")
    else:
        return scope
    return scope.join(near.select(F.col("building_id").alias("id")).distinct(), "id", "left_semi")


def buildings_with_units(buildings: DataFrame, units: DataFrame) -> DataFrame:
    """Buildings with at least one of the given units. The unit ids fold to distinct buildings before the join."""
    return buildings.join(units.select(F.col("building_id").alias("id")).distinct(), "id", "left_semi")


def count_units(units: DataFrame, buildings: DataFrame) -> DataFrame:
    """Number of units whose building is among the given ones."""
    per_building = units.groupBy("building_id").agg(F.count("*").alias("units"))
    return per_building.join(_buildings_in(buildings), "building_id", "left_semi").agg(
        F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units")
    )


def rental_page(
    buildings: DataFrame, units: DataFrame, page: int = 1, size: int = BUILDINGS_PER_PAGE,
    min_rent: int | None = None, max_rent: int | None = None,
) -> DataFrame:
    """A page of buildings that have a unit within the rent bounds, most recently updated first."""
    return recent(buildings_with_units(buildings, filter_units(units, min_rent, max_rent)), "last_updated", page, size)


def with_stations(buildings: DataFrame, links: DataFrame, stations: DataFrame, lines: DataFrame) -> DataFrame:
    """Buildings with their stations and lines, one row per link; a building without links keeps one row."""
    named = stations.select(
        F.col("id").alias("station_id"), F.col("name").alias("station"), F.col("train_line_id").alias("line_id")
    ).join(lines.select(F.col("id").alias("line_id"), F.col("name").alias("line")), "line_id", "left")
    stops = links.select(F.col("building_id").alias("id"), "station_id", "walking_minutes").join(named, "station_id", "left")
    return buildings.join(stops, "id", "left")


def buildings_with_unit_counts(buildings: DataFrame, units: DataFrame) -> DataFrame:
    counts = units.groupBy(F.col("building_id").alias("id")).agg(F.count("*").alias("units"))
    return buildings.join(counts, "id", "left").withColumn("units", F.coalesce("units", F.lit(0)).cast("long"))


def unit_statistics(units: DataFrame) -> DataFrame:
    """Units, lowest and highest rent per building."""
    return units.groupBy("building_id").agg(
        F.count("*").alias("units"), F.min("rent").alias("lowest_rent"), F.max("rent").alias("highest_rent")
    )
