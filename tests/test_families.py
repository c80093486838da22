"""Children stored with the area of their parents."""

import re

from pyspark.sql import functions as F

from estatelake.operators import filters, rentals
from estatelake.plans.search import stored_rental_units
from estatelake.sources import families

SCOPE = {"region": "030", "province": "13"}


def tables(spark, n=4_000):
    """Buildings of 8 areas; a third of all units belongs to one building, some to none."""
    number = F.col("id") % 8
    buildings = spark.range(n).select(
        "id", F.format_string("%03d", number.cast("int") * 10).alias("region"), (F.lit(10) + number).cast("string").alias("province"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 97).cast("int")).alias("last_updated"),
    )
    owner = F.when(F.col("id") % 3 == 0, 3).when(F.col("id") % 50 == 1, None).when(F.col("id") % 50 == 2, n + 7).otherwise(F.col("id") % n)
    units = spark.range(5 * n).select(owner.cast("long").alias("building_id"), (F.col("id") % 1000 * 100).alias("rent"), F.col("id").alias("unit"))
    return buildings, units


def test_area_reaches_the_scan_of_the_children(spark, tmp_path):
    buildings, units = tables(spark)
    root = str(tmp_path / "f")
    families.write_family(root, buildings, {"units": (units, "building_id")}, ranges=16)
    every = families.read_family(spark, root, "units")
    assert sorted(every.drop(*families.AREA).collect(), key=repr) == sorted(units.select("building_id", "rent", "unit").collect(), key=repr)
    assert every.where("region is null").count() == units.where("building_id is null or building_id >= 4000").count()
    area, mine = filters.in_scope(families.read_family(spark, root), **SCOPE), filters.in_scope(every, **SCOPE)
    counted = rentals.count_units(mine, area)
    assert counted.collect() == rentals.count_units(units, filters.in_scope(buildings, **SCOPE)).collect()
    plan = counted._jdf.queryExecution().toString()
    scans = re.findall(r"FileScan parquet .*?PartitionFilters: \[(.*?)\], Pushed", plan)
    # No exchange of the whole unit table: both scans read the directory of one area.
    assert len(scans) >= 2 and all("region" in s and "province" in s for s in scans)
    assert {f.split("/rows/")[1].split("/")[:2] == ["region=030", "province=13"] for f in _files(mine)} == {True}


def _files(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_units_of_a_page_come_from_few_files(spark, tmp_path):
    buildings, units = tables(spark)
    root = str(tmp_path / "f")
    families.write_family(root, buildings, {"units": (units, "building_id")}, ranges=48)
    page = stored_rental_units(spark, root, SCOPE, 2, 20_000, 80_000)
    shown = rentals.rental_page(filters.in_scope(buildings, **SCOPE), units, 2, 10, 20_000, 80_000)
    want = filters.filter_units(units, 20_000, 80_000).join(shown.select(F.col("id").alias("building_id")), "building_id", "left_semi")
    key = lambda rows: sorted((r.building_id, r.rent, r.unit) for r in rows)
    assert key(page.collect()) == key(want.collect()) and shown.count() == 10
    assert re.search(r"PushedFilters: \[.*In\(building_id, \[", page._jdf.queryExecution().toString())
    # The building with a third of all rows lies in several files.
    hot = families.read_family(spark, root, "units").where("building_id = 3")
    assert len(_files(hot)) > 3


def test_empty_family_and_clashing_columns(spark, tmp_path):
    buildings, units = tables(spark, 40)
    root = str(tmp_path / "f")
    families.write_family(root, buildings.limit(0), {"units": (units.limit(0), "building_id")})
    assert families.read_family(spark, root, "units").count() == 0 == stored_rental_units(spark, root, SCOPE).count()
    families.write_family(root, buildings, {"units": (units.withColumn("region", F.lit("x")).withColumn("id", F.lit(1)), "building_id")})
    found = families.read_family(spark, root, "units")
    assert found.where("region = 'x'").count() == 0 and found.where("building_id = 5 and region = '050'").count() > 0
