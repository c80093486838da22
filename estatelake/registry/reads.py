"""Read-side queries: counts, listing pages, rental search, price history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from estatelake.fixed_values import PREFECTURES_JA, REGIONS
from estatelake.functions.labels import age_label, bucket_label, count_bucket, duration_label
from estatelake.functions.measures import floor_area, unit_price
from estatelake.functions.money import man, rent_band, rent_band_label, short_yen, yen
from estatelake.functions.places import prefecture_code, region_of
from estatelake.operators import counts, filters, listings, rentals
from estatelake.operators.filters import filter_listings, listing_condition
from estatelake.registry import query
from estatelake.registry.tables import Tables, with_views
from estatelake.session import shared_folder
from estatelake.plans import search
from estatelake.sources import families, paged

AREA = {"region": "1", "province": "6"}
IN_AREA = "region = '1' AND province = '6'"
SCOPE = {"section_type": "1-URGENT", "region": "1"}


@query(with_views("listing", """SELECT region, province, count(*) AS listings FROM listing
    WHERE section_type = '1-URGENT' GROUP BY region, province"""))
def buy_counts(t: Tables):
    return counts.buy_counts(t.listing, "1-URGENT")


@query(with_views("listing", """SELECT section_type, count(*) AS listings FROM listing WHERE section_type IS NOT NULL
    GROUP BY section_type UNION ALL SELECT '040', count(*) FROM lineitem"""))
def listing_totals(t: Tables):
    return counts.listing_totals(t.listing, t.unit)


@query(with_views("building unit", """SELECT region, province, count(*) AS listings FROM unit
    JOIN building ON building_id = id GROUP BY region, province"""))
def rental_counts(t: Tables):
    return counts.rental_counts(t.unit, t.building)


@query(with_views("listing", """SELECT region, string_agg(province || ':' || n, ',' ORDER BY province) AS provinces FROM
    (SELECT region, province, count(*) AS n FROM listing GROUP BY region, province) GROUP BY region"""))
def nested_counts(t: Tables):
    per_area = t.listing.groupBy("region", "province").agg(F.count("*").alias("listings"))
    entries = F.transform(F.map_entries("provinces"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return counts.as_nested(per_area).select("region", F.array_join(entries, ",").alias("provinces"))


@query(with_views("listing", """SELECT region, province, count(*) AS listings FROM listing
    GROUP BY ROLLUP (region, province)"""))
def area_rollup(t: Tables):
    return counts.area_rollup(t.listing.groupBy("region", "province").agg(F.count("*").alias("listings")))


@query(with_views("listing", """SELECT a.region, a.province, a.province_name, CAST(coalesce(n, 0) AS BIGINT) AS listings,
    CAST(coalesce(sum(n) OVER (PARTITION BY a.region), 0) AS BIGINT) AS region_total,
    CAST(greatest(floor(coalesce(n, 0) * 100 / greatest(max(n) OVER (), 1) + 0.5), 3) AS BIGINT) AS percent
    FROM (SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS province,
        n_name AS province_name FROM nation) a
    LEFT JOIN (SELECT province, count(*) AS n FROM listing WHERE section_type = '2-HIGH' AND price < 30000000
        GROUP BY province) c USING (province)"""))
def area_table(t: Tables):
    areas = t.raw("nation").select(
        F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").cast("string").alias("province"),
        F.col("n_name").alias("province_name"),
    )
    cheap = filter_listings(t.listing, {"section_type": "2-HIGH"}, price="under30")
    return counts.area_table(areas, counts.buy_counts(cheap, "2-HIGH"))


_PAGE = "id, price, region, province, building_area, area, walking_minutes"


@query(with_views("listing", f"""SELECT {_PAGE} FROM listing WHERE section_type = '1-URGENT' AND region = '1'
    ORDER BY price, id LIMIT 12 OFFSET 12"""))
def listing_page(t: Tables):
    rows = filter_listings(t.listing, SCOPE)
    return listings.listing_page(rows, page=2).select(*_PAGE.split(", "))


@query(with_views("listing", f"SELECT {_PAGE} FROM listing ORDER BY price DESC, id LIMIT 12 OFFSET 480"))
def deep_listing_page(t: Tables):
    """Page 41 of all listings, from a copy stored in that order."""
    path = f"{shared_folder(t.spark)}/ordered-{uuid.uuid4().hex}"
    order = [F.desc("price"), F.asc("id")]
    paged.write_in_order(t.listing.select(*_PAGE.split(", ")), path, order, 32)
    return paged.read_page(t.spark, path, order, 41, 12)


@query(with_views("listing", f"""SELECT {_PAGE} FROM listing WHERE section_type = '1-URGENT' AND region = '1'
    AND price >= 60000000 AND price < 100000000 AND (building_area >= 60 OR (building_area = 0 AND area >= 60))
    AND walking_minutes > 0 AND walking_minutes <= 10 ORDER BY price DESC, id LIMIT 12"""))
def listing_page_filtered(t: Tables):
    rows = filter_listings(t.listing, SCOPE, price="60to100", size="60", walk="10")
    return listings.listing_page(rows, sort="price_desc").select(*_PAGE.split(", "))


@query(with_views("listing", """SELECT count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages FROM listing
    WHERE section_type = '1-URGENT' AND region = '1' AND price >= 30000000 AND price < 60000000"""))
def listing_filtered_count(t: Tables):
    return counts.count_pages(filter_listings(t.listing, SCOPE, price="30to60"), 12)


@query(with_views("listing", """SELECT band, size, walk, count(*) AS listings FROM listing
    JOIN (VALUES ('under30', 0, 30000000), ('30to60', 30000000, 60000000), ('60to100', 60000000, 100000000),
        ('over100', 100000000, 9000000000000000)) b(band, low, high) ON price >= low AND price < high
    JOIN (VALUES ('40', 40), ('60', 60), ('80', 80)) s(size, smallest)
        ON building_area >= smallest OR (building_area = 0 AND area >= smallest)
    JOIN (VALUES ('5', 5), ('10', 10), ('15', 15)) w(walk, farthest)
        ON walking_minutes > 0 AND walking_minutes <= farthest
    GROUP BY band, size, walk"""))
def listing_facets(t: Tables):
    """All search options counted in one pass: each listing carries the options it satisfies."""
    from estatelake.fixed_values import PRICE_BANDS, SIZE_MINIMUMS, WALK_MAXIMUMS

    def options(keys, **kind):
        named = [F.when(listing_condition(**{next(iter(kind)): k}), F.lit(k)) for k in keys if k != "any"]
        return F.explode(F.array_compact(F.array(*named)))

    rows = t.listing.select(
        "price", "building_area", "area", "walking_minutes", options(PRICE_BANDS, price=None).alias("band")
    )
    rows = rows.select("band", "walking_minutes", options(SIZE_MINIMUMS, size=None).alias("size"), "building_area", "area")
    return rows.select("band", "size", options(WALK_MAXIMUMS, walk=None).alias("walk")).groupBy(
        "band", "size", "walk"
    ).agg(F.count("*").alias("listings"))


@query(with_views("listing", """SELECT id, floor_area, CASE WHEN floor_area > 0 THEN
    CAST(floor(price / floor_area + 0.5) AS BIGINT) END AS unit_price FROM (SELECT id, price,
    CASE WHEN building_area > 0 THEN building_area ELSE area END AS floor_area FROM listing)"""))
def unit_prices(t: Tables):
    size = floor_area(F.col("building_area"), F.col("area"))
    return t.listing.select(
        "id", size.alias("floor_area"), unit_price(F.col("price"), F.col("building_area"), F.col("area")).alias("unit_price")
    )


@query(with_views("listing", """SELECT id,
    '¥' || format('{:,}', price) AS yen, format('{:,}', CAST(floor(price / 10000.0 + 0.5) AS BIGINT)) || '万円' AS man,
    CASE WHEN price >= 1000000 THEN '¥' || CAST((price + 50000) // 100000 // 10 AS VARCHAR) || '.' ||
        CAST((price + 50000) // 100000 % 10 AS VARCHAR) || 'M'
    ELSE '¥' || CAST(CAST(floor(price / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'K' END AS short_yen FROM listing"""))
def money_labels(t: Tables):
    price = F.col("price")
    return t.listing.select("id", yen(price).alias("yen"), man(price).alias("man"), short_yen(price).alias("short_yen"))


AS_OF = "TIMESTAMP '2001-08-02 12:00:00'"


@query(with_views("listing", f"""SELECT id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day ago'
    WHEN d < 7 THEN d || ' days ago' WHEN d < 14 THEN '1 week ago' WHEN d < 30 THEN (d // 7) || ' weeks ago'
    WHEN d < 60 THEN '1 month ago' ELSE (d // 30) || ' months ago' END AS age FROM
    (SELECT id, CAST(floor(date_diff('second', last_updated, {AS_OF}) / 86400.0) AS BIGINT) AS d FROM listing)"""))
def age_labels(t: Tables):
    as_of = F.to_timestamp_ntz(F.lit("2001-08-02 12:00:00"))
    return t.listing.select("id", age_label(F.col("last_updated"), as_of).alias("age"))


@query(with_views("listing", """SELECT province, listings, bucket, CASE WHEN bucket = 0 THEN '< 50'
    ELSE ['50+', '150+', '400+', '1,000+', '2,500+'][bucket] END AS legend FROM (SELECT province, listings,
    CAST((listings >= 50)::INT + (listings >= 150)::INT + (listings >= 400)::INT + (listings >= 1000)::INT
        + (listings >= 2500)::INT AS INTEGER) AS bucket
    FROM (SELECT province, count(*) AS listings FROM listing GROUP BY province))"""))
def tile_buckets(t: Tables):
    per = t.listing.groupBy("province").agg(F.count("*").alias("listings"))
    return per.withColumn("bucket", count_bucket(F.col("listings"))).withColumn("legend", bucket_label(F.col("bucket")))


# --- rentals ---------------------------------------------------------------------------------------------------------


@query(with_views("building unit", f"""SELECT id, title, last_updated FROM building WHERE {IN_AREA} AND EXISTS
    (SELECT 1 FROM unit WHERE building_id = building.id AND rent >= 50000 AND rent <= 75000)
    ORDER BY last_updated DESC, id LIMIT 10"""))
def rental_page(t: Tables):
    scope = filters.in_scope(t.building, **AREA)
    return rentals.rental_page(scope, t.unit, min_rent=50_000, max_rent=75_000).select("id", "title", "last_updated")


@query(with_views("building unit", f"""SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages
    FROM building WHERE {IN_AREA} AND EXISTS (SELECT 1 FROM unit WHERE building_id = building.id AND rent <= 50000)"""))
def rental_building_count(t: Tables):
    scope = filters.in_scope(t.building, **AREA)
    return counts.count_pages(rentals.buildings_with_units(scope, filters.filter_units(t.unit, max_rent=50_000)), 10)


@query(with_views("building unit", f"""SELECT count(*) AS units FROM unit JOIN building ON building_id = id
    WHERE {IN_AREA} AND rent >= 75000"""))
def rental_unit_count(t: Tables):
    return rentals.count_units(filters.filter_units(t.unit, min_rent=75_000), filters.in_scope(t.building, **AREA))


@query(with_views("unit", """SELECT band, ['Under ¥50,000', '¥50,000 – ¥75,000', '¥75,000 – ¥100,000',
    '¥100,000 – ¥150,000', '¥150,000 – ¥200,000', '¥200,000 – ¥300,000', 'Over ¥300,000'][band + 1] AS label,
    count(*) AS units FROM (SELECT CAST(CASE WHEN rent <= 50000 THEN 0 WHEN rent <= 75000 THEN 1 WHEN rent <= 100000
    THEN 2 WHEN rent <= 150000 THEN 3 WHEN rent <= 200000 THEN 4 WHEN rent <= 300000 THEN 5 ELSE 6 END AS INTEGER)
    AS band FROM unit) GROUP BY band"""))
def rent_bands(t: Tables):
    return (
        t.unit.select(rent_band(F.col("rent")).alias("band")).groupBy("band").agg(F.count("*").alias("units"))
        .withColumn("label", rent_band_label(F.col("band")))
    )


@query(with_views("building station link", f"""SELECT train_line_id, count(DISTINCT building_id) AS buildings
    FROM link JOIN station ON station.id = station_id JOIN building ON building.id = building_id WHERE {IN_AREA}
    GROUP BY train_line_id"""))
def buildings_per_line(t: Tables):
    return rentals.buildings_per_line(t.link, t.station, filters.in_scope(t.building, **AREA))


@query(with_views("building station link line", f"""SELECT id, name, translated_name FROM line WHERE EXISTS
    (SELECT 1 FROM station WHERE train_line_id = line.id AND EXISTS (SELECT 1 FROM link JOIN building ON
    building.id = building_id WHERE station_id = station.id AND {IN_AREA}))"""))
def lines_in_area(t: Tables):
    scope = filters.in_scope(t.building, **AREA)
    return rentals.lines_in_area(t.line, t.station, t.link, scope).select("id", "name", "translated_name")


@query(with_views("building station link line", f"""SELECT line.id, coalesce(nullif(canonical_name, ''),
    nullif(line.translated_name, ''), line.name) AS label, kind = 'bus' AS bus, buildings FROM line JOIN
    (SELECT train_line_id, count(DISTINCT building_id) AS buildings FROM link JOIN station ON station.id = station_id
    JOIN building ON building.id = building_id WHERE {IN_AREA} GROUP BY train_line_id) ON line.id = train_line_id"""))
def line_facet(t: Tables):
    return rentals.line_facet(t.line, t.station, t.link, filters.in_scope(t.building, **AREA))


@query(with_views("building station link", f"""SELECT id, train_line_id, name, name AS label FROM station WHERE
    train_line_id = 6 AND EXISTS (SELECT 1 FROM link JOIN building ON building.id = building_id
    WHERE station_id = station.id AND {IN_AREA})"""))
def stations_in_area(t: Tables):
    return rentals.stations_in_area(t.station, t.link, filters.in_scope(t.building, **AREA), 6)


@query(with_views("building station link", f"""SELECT id, title FROM building WHERE {IN_AREA} AND EXISTS (SELECT 1
    FROM link JOIN station ON station.id = station_id WHERE building_id = building.id AND train_line_id = 6)"""))
def buildings_on_line(t: Tables):
    scope = filters.in_scope(t.building, **AREA)
    return rentals.filter_buildings(scope, t.link, t.station, line_id=6).select("id", "title")


@query(with_views("building link", f"""SELECT id, title FROM building WHERE {IN_AREA} AND EXISTS (SELECT 1 FROM link
    WHERE building_id = building.id AND station_id = 3)"""))
def buildings_near_station(t: Tables):
    scope = filters.in_scope(t.building, **AREA)
    return rentals.filter_buildings(scope, t.link, t.station, station_id=3, line_id=6).select("id", "title")


@query(with_views("building station link line", """SELECT building.id, station_id, walking_minutes, station.name AS station,
    line.name AS line FROM building LEFT JOIN link ON building_id = building.id LEFT JOIN station
    ON station.id = station_id LEFT JOIN line ON line.id = train_line_id"""))
def building_stations(t: Tables):
    return rentals.with_stations(t.building, t.link, t.station, t.line).select(
        "id", "station_id", "walking_minutes", "station", "line"
    )


@query(with_views("building unit", """SELECT id, title, coalesce(n, 0) AS units FROM building LEFT JOIN
    (SELECT building_id, count(*) AS n FROM unit GROUP BY building_id) ON building_id = id"""))
def buildings_with_unit_counts(t: Tables):
    return rentals.buildings_with_unit_counts(t.building, t.unit).select("id", "title", "units")


@query(with_views("unit", """SELECT building_id, count(*) AS units, min(rent) AS lowest_rent, max(rent) AS highest_rent
    FROM unit GROUP BY building_id"""))
def unit_statistics(t: Tables):
    return rentals.unit_statistics(t.unit)


@query(with_views("unit", """SELECT building_id, rent, size, part, station_id, floor, rank FROM (SELECT *,
    CAST(row_number() OVER (PARTITION BY building_id ORDER BY rent, size, part, station_id, floor) AS INTEGER) AS rank
    FROM unit) WHERE rank <= 3"""))
def cheapest_units(t: Tables):
    return listings.cheapest_units(t.unit, 3, ["size", "part", "station_id", "floor"])


# --- children stored with the area of their parents ------------------------------------------------------------------


def _stored_rentals(t: Tables) -> str:
    root = f"{shared_folder(t.spark).rstrip('/')}/family-{uuid.uuid4().hex}"
    families.write_family(root, t.building, {"units": (t.unit, "building_id"), "links": (t.link, "building_id")}, ranges=32)
    return root


@query(with_views("building unit", f"""SELECT building_id, rent, size, part, station_id, floor, region, province
    FROM unit JOIN (SELECT id, region, province FROM building WHERE {IN_AREA} AND EXISTS
    (SELECT 1 FROM unit WHERE building_id = building.id AND rent >= 50000 AND rent <= 75000)
    ORDER BY last_updated DESC, id LIMIT 10 OFFSET 10) ON id = building_id WHERE rent >= 50000 AND rent <= 75000"""))
def stored_rental_units(t: Tables):
    """The second page's units from the stored family."""
    return search.stored_rental_units(t.spark, _stored_rentals(t), AREA, 2, 50_000, 75_000)


@query(with_views("building unit", f"""SELECT count(*) AS units FROM unit JOIN building ON building_id = id
    WHERE {IN_AREA} AND rent >= 75000"""))
def stored_unit_count(t: Tables):
    root = _stored_rentals(t)
    building, units = (filters.in_scope(families.read_family(t.spark, root, n), **AREA) for n in ("parents", "units"))
    return rentals.count_units(filters.filter_units(units, min_rent=75_000), building)


@query(with_views("building station link line", f"""SELECT building.id, station_id, walking_minutes, station.name AS station,
    line.name AS line FROM building LEFT JOIN link ON building_id = building.id LEFT JOIN station
    ON station.id = station_id LEFT JOIN line ON line.id = train_line_id WHERE {IN_AREA}"""))
def stored_building_stations(t: Tables):
    """Stations of an area's buildings from the stored family."""
    root = _stored_rentals(t)
    building, links = (filters.in_scope(families.read_family(t.spark, root, n), **AREA) for n in ("parents", "links"))
    return rentals.with_stations(building, links.drop(*families.AREA), t.station, t.line).select(
        "id", "station_id", "walking_minutes", "station", "line"
    )


@query(with_views("listing history", """SELECT id, l.price, building_area, region, greatest(coalesce(max(CASE WHEN n = 2 THEN h.price END)
    - max(CASE WHEN n = 1 THEN h.price END), 0), 0) AS cut FROM
    (SELECT * FROM listing WHERE section_type = '1-URGENT' AND region = '1' AND province = '6' ORDER BY price, id LIMIT 12) l
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY recorded_at DESC, price DESC) AS n FROM history) h
    ON property_id = id AND n <= 2 GROUP BY id, l.price, building_area, region"""))
def stored_listing_search(t: Tables):
    """A search page whose price history is stored with the listings' areas."""
    root = f"{shared_folder(t.spark).rstrip('/')}/family-{uuid.uuid4().hex}"
    families.write_family(root, t.listing, {"history": (t.history.drop("price_text"), "property_id")}, ranges=32)
    listing, history = (families.read_family(t.spark, root, n) for n in ("parents", "history"))
    page = search.listing_search(listing, history, {"section_type": "1-URGENT", **AREA})
    return page.select("id", "price", "building_area", "region", "cut")


# --- price history ---------------------------------------------------------------------------------------------------


@query(with_views("history", """SELECT property_id, max(CASE WHEN n = 1 THEN price END) AS latest,
    max(CASE WHEN n = 2 THEN price END) AS previous, greatest(coalesce(max(CASE WHEN n = 2 THEN price END)
    - max(CASE WHEN n = 1 THEN price END), 0), 0) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY property_id
    ORDER BY recorded_at DESC, event_id DESC) AS n FROM history) WHERE n <= 2 GROUP BY property_id"""))
def price_cuts(t: Tables):
    return listings.price_cuts(t.history, ties=["event_id"])


@query(with_views("history", """SELECT property_id, min(price) AS lowest, max(price) AS highest,
    max(price) - min(price) AS spread, count(*) AS points FROM history GROUP BY property_id"""))
def price_summary(t: Tables):
    return listings.price_summary(t.history)


@query(with_views("history", """SELECT property_id, event_id, price, price_text, recorded_at FROM (SELECT *,
    lag(price) OVER w AS p, lag(price_text) OVER w AS x, row_number() OVER w AS n FROM history
    WINDOW w AS (PARTITION BY property_id ORDER BY recorded_at, event_id)) WHERE n > 1
    AND (p IS DISTINCT FROM price OR coalesce(x, '') <> coalesce(price_text, ''))"""))
def price_changes(t: Tables):
    day = F.date_trunc("day", F.col("recorded_at"))
    rows = listings.detect_changes(t.history, "property_id", ["recorded_at", "event_id"], ["price", "price_text"], day)
    return rows.select("property_id", "event_id", "price", "price_text", "recorded_at")


@query(with_views("listing history", """SELECT l.id, l.price, h.price AS point, h.recorded_at, row_number() OVER
    (PARTITION BY l.id ORDER BY h.recorded_at, h.event_id) AS child_no FROM (SELECT * FROM listing
    WHERE section_type = '1-URGENT' AND region = '1' ORDER BY price, id LIMIT 12) l
    LEFT JOIN history h ON h.property_id = l.id"""))
def listing_with_history(t: Tables):
    page = listings.listing_page(filter_listings(t.listing, SCOPE)).select("id", "price")
    points = t.history.select("property_id", F.col("price").alias("point"), "recorded_at", "event_id")
    order = [F.asc("recorded_at"), F.asc("event_id")]
    day = F.date_trunc("day", F.col("recorded_at"))
    rows = listings.with_children(page, points, "id", order, day, "property_id").drop("event_id")
    return rows.withColumn("child_no", F.coalesce("child_no", F.lit(1)).cast("long"))


# --- runs ------------------------------------------------------------------------------------------------------------


@query(with_views("run", """SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
    CAST(floor(count(*) FILTER (status = 'completed') * 100.0 / count(*) + 0.5) AS BIGINT) AS success_rate FROM run"""))
def run_stats(t: Tables):
    return counts.run_stats(t.run)


@query(with_views("run", """SELECT id, status, start_time FROM run ORDER BY start_time DESC, id LIMIT 10 OFFSET 10"""))
def recent_runs(t: Tables):
    return listings.recent(t.run, "start_time", page=2)


@query(with_views("run", """SELECT id, status, start_time FROM run ORDER BY start_time DESC, id DESC LIMIT 1"""))
def latest_run(t: Tables):
    return listings.latest_run(t.run)


@query(with_views("run", """SELECT id, CASE WHEN finish IS NULL THEN 'In progress' ELSE
    (date_sub('second', start_time, finish) // 60) || 'm ' || (date_sub('second', start_time, finish) % 60) || 's'
    END AS duration FROM (SELECT user_id AS id, min(ts) AS start_time,
    max(CASE WHEN event_type = 'purchase' THEN ts END) AS finish FROM events GROUP BY user_id)"""))
def run_durations(t: Tables):
    spans = t.raw("events").groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("start_time"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finish")
    )
    return spans.select("id", duration_label(F.col("start_time"), F.col("finish")).alias("duration"))


@query(with_views("listing", """SELECT id, price, last_updated FROM listing WHERE id = 42"""))
def listing_by_id(t: Tables):
    return filters.get_by_id(t.listing, 42).select("id", "price", "last_updated")


_PLACE = ", ".join(
    f"({i}, '{PREFECTURES_JA[i - 1]}', '{i:02d}', '{region}')"
    for region, _, first, names in REGIONS for i in range(first, first + len(names))
)
# Every listing has an address in one of 47 prefectures or in none that is known; a third is already stored under it.
_MOVES = f"""SELECT CASE WHEN o.id % 3 = 0 AND n IS NOT NULL THEN p.region ELSE o.region END AS old_region,
    CASE WHEN o.id % 3 = 0 AND n IS NOT NULL THEN p.code ELSE o.province END AS old_province, p.region AS new_region, p.code AS new_province, p.name AS state
    FROM listing o LEFT JOIN (VALUES {_PLACE}) AS p(n, name, code, region) ON n = o.id % 50"""


def _addressed(t: Tables):
    names = F.array(*[F.lit(p) for p in PREFECTURES_JA])
    rows = t.listing.withColumn("state", F.when((F.col("id") % 50).between(1, 47), F.get(names, (F.col("id") % 50 - 1).cast("int"))).otherwise("?"))
    done = (F.col("id") % 3 == 0) & (F.col("state") != "?")
    code = prefecture_code(F.col("state"))
    return rows.withColumns({
        "region": F.when(done, region_of(code)).otherwise(F.col("region")), "province": F.when(done, code).otherwise(F.col("province")),
    })


@query(with_views("listing", """SELECT old_region, old_province, new_region, new_province, state, count(*) AS rows
    FROM moved WHERE state IS NOT NULL AND (old_region <> new_region OR old_province <> new_province)
    GROUP BY old_region, old_province, new_region, new_province, state""", moved=_MOVES))
def location_transitions(t: Tables):
    """What the prefectures of the listings' addresses would change in their region and province."""
    return counts.location_transitions(_addressed(t))


@query(with_views("listing", """SELECT id, CASE section_type WHEN '1-URGENT' THEN '賃貸' WHEN '2-HIGH' THEN '土地'
    ELSE status END AS property_type FROM listing"""))
def relabel_types(t: Tables):
    from estatelake.sources.dims import listing_types

    names = listing_types(t.spark).select(
        F.when(F.col("type") == "040", "1-URGENT").when(F.col("type") == "030", "2-HIGH").otherwise(F.col("type")).alias("type"),
        "type_name_ja",
    )
    rows = t.listing.select("id", "section_type", F.col("status").alias("property_type"))
    return counts.relabel_types(rows, names).select("id", "property_type")


@query(with_views("listing building unit", """SELECT section_type, region, province, count(*) AS listings FROM listing
    GROUP BY section_type, region, province UNION ALL SELECT '040', region, province, count(*) FROM unit
    JOIN building ON building_id = id GROUP BY region, province"""))
def refreshed_counts(t: Tables):
    return counts.refresh_counts(t.listing, t.unit, t.building)


@query("""SELECT c_custkey AS id, c_acctbal AS price FROM customer LEFT JOIN (SELECT user_id, max(ts) AS requested_at,
    arg_max(event_type, ts) AS status FROM events GROUP BY user_id) ON user_id = c_custkey LEFT JOIN (SELECT o_custkey,
    max(o_orderdate) AS fetched FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    WHERE NOT coalesce(date_diff('second', fetched + INTERVAL 22 YEAR + INTERVAL 6 MONTH, TIMESTAMP '2024-01-31') < 604800, FALSE)
    AND NOT coalesce(status IN ('view', 'click'), FALSE)
    AND NOT coalesce(status = 'error' AND date_sub('second', requested_at, TIMESTAMP '2024-01-31') < 3600, FALSE)""")
def due_for_refresh(t: Tables):
    fetched = t.raw("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        (F.max("o_orderdate") + F.expr("INTERVAL '22-6' YEAR TO MONTH")).alias("detail_fetched_at")
    )
    customers = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price")).join(
        fetched, "id", "left"
    )
    last = t.raw("events").groupBy(F.col("user_id").alias("property_id")).agg(
        F.max_by("event_type", "ts").alias("event"), F.max("ts").alias("requested_at")
    )
    names = F.when(F.col("event") == "view", "queued").when(F.col("event") == "click", "running").when(
        F.col("event") == "error", "failed"
    )
    requests = last.select("property_id", "requested_at", names.alias("status"))
    as_of = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    return filters.due_for_refresh(customers, requests, as_of).select("id", "price")


@query(with_views("places history", """SELECT c_custkey AS id, c_name, h.price, h.recorded_at, row_number() OVER (PARTITION BY c_custkey
    ORDER BY h.recorded_at, h.event_id) AS child_no FROM places LEFT JOIN history h ON property_id = c_custkey"""))
def customers_with_history(t: Tables):
    """Every customer with all its price points in order."""
    parents = t.places.select(F.col("c_custkey").alias("id"), "c_name")
    points = t.history.select("property_id", "price", "recorded_at", "event_id")
    day = F.date_trunc("day", F.col("recorded_at"))
    order = [F.asc("recorded_at"), F.asc("event_id")]
    rows = listings.with_children(parents, points, "id", order, day, "property_id").drop("event_id")
    return rows.withColumn("child_no", F.coalesce("child_no", F.lit(1)).cast("long"))


@query(with_views("listing history", """, page AS (SELECT * FROM listing WHERE section_type = '1-URGENT' AND price < 30000000 ORDER BY price DESC, id
    LIMIT 12), two AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY recorded_at DESC, price DESC) AS n FROM history
    WHERE property_id IN (SELECT id FROM page)) SELECT id, price, CASE WHEN building_area > 0 OR area > 0 THEN CAST(floor(price /
    CASE WHEN building_area > 0 THEN building_area ELSE area END + 0.5) AS BIGINT) END AS unit_price, greatest(coalesce((SELECT price FROM two
    WHERE property_id = id AND n = 2) - (SELECT price FROM two WHERE property_id = id AND n = 1), 0), 0) AS cut FROM page"""))
def listing_search(t: Tables):
    """The search page as a whole: filter, order, page, last price cut and unit price."""
    from estatelake.plans.search import listing_search as search

    rows = search(t.listing, t.history, {"section_type": "1-URGENT"}, "price_desc", price="under30")
    return rows.select("id", "price", "unit_price", "cut")


@query("SELECT page_id, CAST(length(html) AS INTEGER) AS chars FROM pages WHERE contains(url, '.example.com/')")
def pages_of_site(t: Tables):
    """A scan of stored pages that reads only the pages of one host."""
    return t.raw("pages").where(F.contains("url", F.lit(".example.com/"))).select("page_id", F.length("html").alias("chars"))
