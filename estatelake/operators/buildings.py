"""Duplicate buildings: which stored buildings are one listed building, the reviewed plan, and its application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.operators.filters import keyed_buildings, legacy_buildings
from estatelake.session import settled


def listed_units(buildings: DataFrame) -> DataFrame:
    """(unit_key, building_key) of extracted rental buildings, without those whose page gave no id."""
    return keyed_buildings(buildings).select("building_key", F.explode("units.source_id").alias("unit_key")).select(
        "unit_key", "building_key"
    )


def unit_key_index(listed: DataFrame) -> DataFrame:
    """Building key of every listed unit, null where pages list it under different keys. Lowest and highest key decide
    that, so nothing is gathered per unit."""
    return listed.groupBy("unit_key").agg(
        F.when(F.min("building_key") == F.max("building_key"), F.min("building_key")).alias("building_key")
    )


def classify_buildings(buildings: DataFrame, units: DataFrame, index: DataFrame) -> DataFrame:
    """Verdict on every stored building: (building_id, unit_count, verdict, building_key). It merges into a key when all
    its units are listed under that key; otherwise the verdict names the reason, the first of no-units, ambiguous-unit,
    mixed-buildings and uncovered-unit that holds."""
    listed = index.select("unit_key", "building_key", F.lit(True).alias("_listed"))
    per_building = (
        units.select("building_id", F.col("source_id").alias("unit_key"))
        .join(listed, "unit_key", "left")
        .groupBy("building_id")
        .agg(
            F.count("*").alias("unit_count"),
            F.count_if(F.col("_listed").isNotNull() & F.col("building_key").isNull()).alias("_ambiguous"),
            F.count_if(F.col("_listed").isNull()).alias("_uncovered"),
            F.min("building_key").alias("_low"),
            F.max("building_key").alias("_high"),
        )
    )
    rows = buildings.select(F.col("id").alias("building_id")).join(per_building, "building_id", "left")
    verdict = (
        F.when(F.col("unit_count").isNull(), "no-units")
        .when(F.col("_ambiguous") > 0, "ambiguous-unit")
        .when(F.col("_low") != F.col("_high"), "mixed-buildings")
        .when((F.col("_uncovered") > 0) | F.col("_low").isNull(), "uncovered-unit")
        .otherwise("merge")
    )
    return rows.select(
        "building_id", F.coalesce("unit_count", F.lit(0)).alias("unit_count"), verdict.alias("verdict"),
        F.when(verdict == "merge", F.col("_low")).alias("building_key"),
    )


def skip_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict") != "merge").groupBy("verdict").agg(F.count("*").alias("buildings"))


def merge_plan(verdicts: DataFrame, buildings: DataFrame) -> DataFrame:
    """One row per building to merge: (building_key, keep_id, source_id, unit_count). ``keep_id`` is the stored building
    that already has the key, if any."""
    keep = buildings.select(F.col("source_id").alias("building_key"), F.col("id").alias("keep_id"))
    return (
        verdicts.where(F.col("verdict") == "merge")
        .join(keep, "building_key", "left")
        .select("building_key", "keep_id", F.col("building_id").alias("source_id"), "unit_count")
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """Groups, groups merged into a stored key, buildings in them, buildings removed and units concerned."""
    groups = plan.groupBy("building_key").agg(
        F.count("*").alias("sources"), F.max("keep_id").alias("keep_id"), F.sum("unit_count").alias("units")
    )
    return groups.agg(
        F.count("*").alias("groups"),
        F.count("keep_id").alias("kept_existing"),
        F.coalesce(F.sum("sources"), F.lit(0)).alias("source_rows"),
        (F.coalesce(F.sum("sources"), F.lit(0)) - (F.count("*") - F.count("keep_id"))).alias("rows_removed"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
    )


def building_keepers(plan: DataFrame) -> DataFrame:
    """(building_key, target_id, existing): the stored building with the key, else the one with the most units, else
    the lowest id."""
    return plan.groupBy("building_key").agg(
        F.coalesce(
            F.max("keep_id"), F.min_by("source_id", F.struct(-F.col("unit_count"), F.col("source_id")))
        ).alias("target_id"),
        F.max("keep_id").isNotNull().alias("existing"),
    )


@dataclass
class MergedBuildings:
    building: DataFrame
    unit: DataFrame
    link: DataFrame
    outcome: DataFrame


def apply_building_merges(
    plan: DataFrame, index: DataFrame, buildings: DataFrame, units: DataFrame, links: DataFrame
) -> MergedBuildings:
    """Buildings, units and station links after the plan's groups, each checked again against the current tables.

    A group with a missing building or a building whose verdict changed is left alone and reported as ``changed``. The
    target keeps its own station links and their minutes; of several moved links to one station the lowest building and
    link id stays. ``outcome`` has one row per group with what it removed, moved and dropped.
    """
    fresh = classify_buildings(
        buildings.join(plan.select(F.col("source_id").alias("id")), "id", "left_semi"), units, index
    ).select(F.col("building_id").alias("source_id"), "verdict", F.col("building_key").alias("_now"), F.col("unit_count").alias("_units"))
    stored = buildings.select(F.col("source_id").alias("building_key"), F.col("id").alias("keep_id"))
    fits = F.coalesce((F.col("verdict") == "merge") & (F.col("_now") == F.col("building_key")), F.lit(False))
    # All four outputs follow from this table of planned buildings, which is small beside the tables it changes.
    checked = settled(
        plan.drop("keep_id", "unit_count").join(fresh, "source_id", "left").join(stored, "building_key", "left")
        .select("building_key", "source_id", "keep_id", F.col("_units").alias("unit_count"), fits.cast("int").alias("_fit"))
    )
    groups = checked.groupBy("building_key").agg(F.min("_fit").alias("_fits"))
    targets = building_keepers(
        checked.join(groups.where("_fits = 1").select("building_key"), "building_key", "left_semi")
    )
    moving = (
        checked.join(targets, "building_key")
        .where(F.col("source_id") != F.col("target_id"))
        .select("building_key", F.col("source_id").alias("building_id"), "target_id")
    )
    rekeyed = targets.where(~F.col("existing")).select(F.col("target_id").alias("id"), F.col("building_key").alias("_key"))
    after_buildings = (
        buildings.join(moving.select(F.col("building_id").alias("id")), "id", "left_anti")
        .join(rekeyed, "id", "left")
        .select(*[F.coalesce("_key", c).alias(c) if c == "source_id" else F.col(c) for c in buildings.columns])
    )
    to = moving.select("building_id", "target_id")
    after_units = units.join(to, "building_id", "left").select(
        *[F.coalesce("target_id", c).alias(c) if c == "building_id" else F.col(c) for c in units.columns]
    )
    # Links of untouched buildings pass by; the others fold to one per (target, station), the target's own first.
    aims = to.unionByName(targets.select(F.col("target_id").alias("building_id"), "target_id"))
    placed = links.join(aims, "building_id", "left")
    rest = [c for c in links.columns if c not in ("building_id", "station_id")]
    order = F.struct((F.col("building_id") != F.col("target_id")).alias("moved"), "building_id", "id")
    folded = (
        placed.where(F.col("target_id").isNotNull())
        .groupBy("target_id", "station_id")
        .agg(
            F.min_by(F.struct("building_id", *rest), order).alias("l"),
            F.count("*").alias("_links"),
        )
    )
    after_links = placed.where(F.col("target_id").isNull()).select(*links.columns).unionByName(
        folded.select(F.col("target_id").alias("building_id"), "station_id", *[f"l.{c}" for c in rest]).select(*links.columns)
    )
    removed = moving.groupBy("building_key").agg(F.count("*").alias("rows_removed"))
    unit_moves = (
        units.groupBy("building_id").agg(F.count("*").alias("_n")).join(moving, "building_id")
        .groupBy("building_key").agg(F.sum("_n").alias("units_moved"))
    )
    station_moves = (
        folded.join(targets.select("target_id", "building_key"), "target_id")
        .groupBy("building_key")
        .agg(
            F.count_if(F.col("l.building_id") != F.col("target_id")).alias("stations_moved"),
            F.sum(F.col("_links") - 1).alias("stations_dropped"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    outcome = (
        groups.join(removed, "building_key", "left").join(unit_moves, "building_key", "left")
        .join(station_moves, "building_key", "left")
        .select(
            "building_key", F.when(F.col("_fits") == 1, "merged").otherwise("changed").alias("outcome"),
            zero("rows_removed"), zero("units_moved"), zero("stations_moved"), zero("stations_dropped"),
        )
    )
    return MergedBuildings(after_buildings, after_units, after_links, outcome)


def plan_building_merges(buildings: DataFrame, units: DataFrame, listed: DataFrame) -> DataFrame:
    """The whole dry run: listed units to index, legacy buildings to verdicts, verdicts to plan."""
    verdicts = classify_buildings(legacy_buildings(buildings), units, unit_key_index(listed))
    return merge_plan(verdicts, buildings)
