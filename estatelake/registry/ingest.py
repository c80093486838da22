"""Ingest queries: upserts of listings, units, buildings and transit, run metrics, and their companions."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelake.operators import counts, listings, metrics, upserts
from estatelake.operators.listings import with_children
from estatelake.operators.ordered import latest_per_key
from estatelake.registry import query
from estatelake.registry.tables import Tables, with_views
from estatelake.sources import pages as page_source
from estatelake.sources.tables import conform

CUT = "2024-01-08 00:00:00"
AS_OF = "2024-02-01 00:00:00"


def _as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def stored_listings(t: Tables):
    """The last observation of every key before the cut, as the stored snapshot."""
    before = t.observation.where(F.col("ts") < F.to_timestamp_ntz(F.lit(CUT)))
    rows = latest_per_key(before, ["source_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select(
        (F.col("event_id") + 1).alias("id"), "source_id", "section_type", "price", "price_text", "region", "province",
        F.col("ts").alias("last_updated"),
    )


def observed_batch(t: Tables):
    """Everything observed after the cut, in order."""
    after = t.observation.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(CUT)))
    return after.select(
        "source_id", "section_type", "price", "price_text", "region", "province", F.col("event_id").alias("ordinal")
    )


_STORED = f"""SELECT event_id + 1 AS id, * EXCLUDE (event_id) FROM (SELECT *, row_number() OVER (PARTITION BY source_id
    ORDER BY ts DESC, event_id DESC) AS n FROM observation WHERE ts < TIMESTAMP '{CUT}') WHERE n = 1"""
_BATCH = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_id DESC) AS n
    FROM observation WHERE ts >= TIMESTAMP '{CUT}') WHERE n = 1"""
_BOTH = """SELECT coalesce(s.source_id, b.source_id) AS source_id, s.id, s.ts, s.section_type AS s_section,
    b.section_type AS b_section, s.price AS s_price, b.price AS b_price, s.price_text AS s_text, b.price_text AS b_text,
    s.region AS s_region, b.region AS b_region, s.province AS s_province, b.province AS b_province,
    s.source_id IS NULL AS is_new, b.source_id IS NULL AS is_absent,
    coalesce(m.priced, FALSE) AS priced, coalesce(m.rent_moved, FALSE) AS rent_moved,
    s.region IS DISTINCT FROM b.region OR s.province IS DISTINCT FROM b.province AS placed
    FROM stored s FULL OUTER JOIN batch b ON s.source_id = b.source_id LEFT JOIN moved m ON m.source_id = b.source_id"""
# The stored row of each key followed by all its rows of the batch, each with what was known before it.
_STEPS = f"""SELECT *, known AND n >= 0 AND price IS DISTINCT FROM p_price AS rent_moved, known AND n >= 0 AND
    (price IS DISTINCT FROM p_price OR coalesce(price_text, '') <> coalesce(p_text, '')) AS priced FROM (SELECT *, lag(n) OVER w IS NOT NULL
    AS known, lag(price) OVER w AS p_price, lag(price_text) OVER w AS p_text FROM (SELECT source_id, id, price, price_text, -1 AS n FROM stored
    UNION ALL SELECT o.source_id, s.id, o.price, o.price_text, o.event_id FROM observation o LEFT JOIN stored s ON s.source_id = o.source_id
    WHERE o.ts >= TIMESTAMP '{CUT}') WINDOW w AS (PARTITION BY source_id ORDER BY n))"""
_MOVED = "SELECT source_id, bool_or(priced) AS priced, bool_or(rent_moved) AS rent_moved FROM steps GROUP BY source_id"


def _upsert_sql(body: str) -> str:
    return with_views("observation", body, stored=_STORED, batch=_BATCH, steps=_STEPS, moved=_MOVED, pairs=_BOTH)


def _listings(t: Tables):
    return upserts.upsert_listings(stored_listings(t), observed_batch(t), _as_of())


@query(_upsert_sql(f"""SELECT source_id, CASE WHEN is_new THEN b_section ELSE s_section END AS section_type,
    CASE WHEN is_absent THEN s_price WHEN is_new OR priced THEN b_price ELSE s_price END AS price,
    CASE WHEN is_absent THEN s_text WHEN is_new THEN b_text WHEN priced THEN nullif(b_text, '') ELSE s_text END AS price_text,
    CASE WHEN is_absent THEN s_region ELSE b_region END AS region,
    CASE WHEN is_absent THEN s_province ELSE b_province END AS province,
    CASE WHEN is_absent THEN ts WHEN is_new OR priced THEN TIMESTAMP '{AS_OF}' ELSE ts END AS last_updated FROM pairs"""))
def upsert_snapshot(t: Tables):
    return _listings(t).snapshot.drop("id")


@query(_upsert_sql(f"""SELECT id AS property_id, price, nullif(price_text, '') AS price_text,
    TIMESTAMP '{AS_OF}' AS recorded_at FROM steps WHERE id IS NOT NULL AND priced"""))
def upsert_history(t: Tables):
    """Changes of the listings that were stored before."""
    top = stored_listings(t).agg(F.max("id")).scalar()
    return _listings(t).history.where(F.col("property_id") <= top)


@query(_upsert_sql("SELECT source_id, price, nullif(price_text, '') AS price_text FROM steps WHERE priced"))
def upsert_all_steps(t: Tables):
    """Every change within the batch, of new listings too."""
    done = _listings(t)
    keys = done.snapshot.select(F.col("id").alias("property_id"), "source_id")
    return done.history.join(keys, "property_id").select("source_id", "price", "price_text")


@query(_upsert_sql("""SELECT source_id, CASE WHEN is_new THEN 'new' WHEN priced OR placed THEN 'updated'
    ELSE 'unchanged' END AS metric_status, CASE WHEN is_new THEN 'insert' WHEN priced THEN 'price' WHEN placed THEN 'place'
    ELSE 'keep' END AS write_status FROM pairs WHERE NOT is_absent"""))
def upsert_classified(t: Tables):
    return _listings(t).classified


_NEW_IDS = """SELECT count(*) AS rows, count(DISTINCT source_id) AS keys, CAST(count(*) FILTER (is_new) AS BIGINT) AS added,
    (SELECT max(id) FROM stored) + count(*) FILTER (is_new) AS highest_id FROM pairs"""


@query(_upsert_sql(_NEW_IDS))
def upsert_new_ids(t: Tables):
    """New listings take the ids right above the stored ones, without gaps."""
    top = stored_listings(t).agg(F.max("id")).scalar()
    after = _listings(t).snapshot
    return after.agg(
        F.count("*").alias("rows"), F.count_distinct("source_id").alias("keys"), F.count_if(F.col("id") > top).alias("added"),
        F.max("id").alias("highest_id"),
    )


# --- rental units ----------------------------------------------------------------------------------------------------


def _stored_units(t: Tables):
    rows = stored_listings(t)
    return rows.select(
        "id", "source_id", F.col("id").alias("building_id"), F.col("price").alias("rent"),
        F.col("price_text").alias("rent_text"), "last_updated",
    )


def _unit_batch(t: Tables):
    return observed_batch(t).select(
        "source_id", F.col("price").alias("rent"), F.col("price_text").alias("rent_text"), "ordinal",
        F.concat(F.lit("building-"), "region").alias("building_key"),
    )


def _units(t: Tables):
    owners = t.observation.select("region").distinct().select(
        F.ascii("region").cast("long").alias("id"), F.concat(F.lit("building-"), "region").alias("source_id")
    )
    return upserts.upsert_units(_stored_units(t), _unit_batch(t), owners, _as_of())


@query(_upsert_sql(f"""SELECT source_id, CASE WHEN is_new THEN ascii(b_region) ELSE id END AS building_id,
    CASE WHEN is_new OR rent_moved THEN b_price ELSE s_price END AS rent,
    CASE WHEN is_new THEN b_text WHEN rent_moved THEN nullif(b_text, '') ELSE s_text END AS rent_text,
    CASE WHEN is_new OR rent_moved THEN TIMESTAMP '{AS_OF}' ELSE ts END AS last_updated
    FROM pairs"""))
def unit_upsert_snapshot(t: Tables):
    return _units(t).snapshot.drop("id")


@query(_upsert_sql("""SELECT count(*) AS rows, count(*) FILTER (id IS NULL) AS first_rows, CAST(sum(price) AS BIGINT) AS rents,
    count(nullif(price_text, '')) AS texts FROM steps WHERE n >= 0 AND (NOT known OR rent_moved)"""))
def unit_upsert_history(t: Tables):
    top = _stored_units(t).agg(F.max("id")).scalar()
    return _units(t).history.agg(
        F.count("*").alias("rows"), F.count_if(F.col("rental_unit_id") > top).alias("first_rows"),
        F.sum("rent").alias("rents"), F.count("rent_text").alias("texts"),
    )


@query(_upsert_sql("""SELECT source_id, CASE WHEN is_new THEN 'new' WHEN rent_moved THEN 'updated'
    ELSE 'unchanged' END AS metric_status FROM pairs WHERE NOT is_absent"""))
def unit_upsert_classified(t: Tables):
    return _units(t).classified.select("source_id", "metric_status")


# --- buildings and transit -------------------------------------------------------------------------------------------


def _listed_units(t: Tables):
    """Line items as listed units of the customer's building."""
    owner = t.raw("orders").select("o_orderkey", F.concat(F.lit("building-"), "o_custkey").alias("building_key"))
    return t.raw("lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"), "building_key",
        F.concat_ws("?", F.concat(F.lit("/unit/"), "l_partkey"), F.lit("a=1")).alias("url"),
        F.col("l_returnflag").alias("building_type"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
        F.col("l_suppkey"),
    )


_LISTED = """SELECT l_orderkey || '-' || l_linenumber AS unit_key, 'building-' || o_custkey AS building_key, l_orderkey,
    l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "building_type"]


@query(with_views("", """SELECT building_key AS source_id, '/unit/' || l_partkey AS url, l_returnflag AS building_type FROM
    (SELECT *, row_number() OVER (PARTITION BY building_key ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_returnflag) AS n FROM listed) WHERE n = 1""", listed=_LISTED))
def first_seen_buildings(t: Tables):
    return upserts.first_seen_buildings(_listed_units(t), _ORDER)


@query(with_views("", f"""SELECT coalesce(b.source_id, s.source_id) AS source_id, b.building_type AS stored_type,
    CASE WHEN b.source_id IS NULL THEN s.building_type ELSE b.building_type END AS building_type,
    CASE WHEN s.source_id IS NULL THEN b.last_updated ELSE TIMESTAMP '{AS_OF}' END AS last_updated
    FROM (SELECT 'building-' || c_custkey AS source_id, c_mktsegment AS building_type, TIMESTAMP '2020-01-01' AS last_updated
        FROM customer WHERE c_mktsegment <> 'BUILDING') b
    FULL OUTER JOIN (SELECT building_key AS source_id, l_returnflag AS building_type FROM (SELECT *, row_number() OVER
        (PARTITION BY building_key ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM listed)
        WHERE n = 1) s ON b.source_id = s.source_id""", listed=_LISTED))
def upsert_buildings(t: Tables):
    stored = t.raw("customer").where(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("building-"), "c_custkey").alias("source_id"),
        F.col("c_mktsegment").alias("building_type"), F.col("c_mktsegment").alias("stored_type"),
        F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")).alias("last_updated"),
    )
    seen = upserts.first_seen_buildings(_listed_units(t), _ORDER)
    return upserts.upsert_buildings(stored, seen, _as_of()).drop("id")


_HELD = "SELECT DISTINCT l_orderkey || '-' || l_linenumber AS unit_key, l_orderkey * 10 + l_linenumber AS unit_id, l_orderkey AS building_id FROM lineitem"


@query(with_views("", """, offers AS (SELECT building_id, building_key, min(unit_id) AS unit_id FROM
    (SELECT DISTINCT unit_key, building_key FROM listed) JOIN held USING (unit_key)
    WHERE building_key NOT IN (SELECT 'building-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    GROUP BY building_id, building_key),
    one AS (SELECT building_id, arg_min(building_key, unit_id) AS building_key, min(unit_id) AS unit_id FROM offers
    GROUP BY building_id),
    won AS (SELECT building_key, arg_min(building_id, unit_id) AS id FROM one GROUP BY building_key)
    SELECT id, coalesce(building_key, source_id) AS source_id FROM
    (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS source_id FROM orders UNION ALL SELECT -c_custkey - 1,
    'building-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') LEFT JOIN won USING (id)""", listed=_LISTED, held=_HELD))
def rekeyed_buildings(t: Tables):
    keyed = t.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select(
        (-F.col("c_custkey") - 1).alias("id"), F.concat(F.lit("building-"), "c_custkey").alias("source_id")
    )
    stored = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("source_id"))
    held = t.raw("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("building_id"),
    ).distinct()
    return upserts.rekey_buildings(_listed_units(t), held, stored.unionByName(keyed))


def _stops(t: Tables):
    """Suppliers of an order's lines as the stops of its building."""
    named = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.raw("lineitem").join(named, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("building_id"), F.col("n_name").alias("line"), F.col("s_name").alias("station"),
        F.col("l_linenumber").alias("walking_minutes"), F.lit("010").alias("region"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("ordinal"),
    )


def _transit(t: Tables):
    line = t.raw("nation").where(F.col("n_regionkey") < 3).select(
        F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("name"),
        F.lit(None).cast("string").alias("translated_name"), F.lit(None).cast("string").alias("operator"),
        F.lit("020").alias("region"), F.lit("rail").alias("kind"), F.lit(None).cast("string").alias("canonical_id"),
        F.lit(None).cast("string").alias("canonical_name"),
    )
    station = t.raw("supplier").join(line.select(F.col("id").alias("s_nationkey")), "s_nationkey", "left_semi").where(
        F.col("s_acctbal") > 0
    ).select(
        F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"), F.lit(None).cast("string").alias("translated_name"),
        F.col("s_nationkey").cast("long").alias("train_line_id"),
    )
    link = t.raw("lineitem").where(F.col("l_returnflag") == "R").join(
        station.select(F.col("id").alias("l_suppkey")), "l_suppkey", "left_semi"
    ).groupBy(F.col("l_orderkey").alias("building_id"), F.col("l_suppkey").alias("station_id")).agg(
        F.lit(99).alias("walking_minutes")
    ).select(
        (F.col("building_id") * 100_000 + F.col("station_id")).alias("id"), "building_id", "station_id", "walking_minutes",
        F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")).alias("last_updated"),
    )
    return upserts.upsert_transit(_stops(t), line, station, link, _as_of())


@query("""SELECT n_name_shown AS name, kind, region, n_nationkey < 0 AS is_new FROM (SELECT CASE WHEN n_regionkey < 3
    THEN lower(n_name) ELSE n_name END AS n_name_shown, CASE WHEN n_regionkey < 3 THEN 'rail' ELSE 'unknown' END AS kind,
    CASE WHEN n_regionkey < 3 THEN '020' ELSE '010' END AS region, CASE WHEN n_regionkey < 3 THEN n_nationkey ELSE -1 END
    AS n_nationkey FROM nation WHERE n_regionkey < 3 OR n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem
    ON l_suppkey = s_suppkey))""")
def transit_lines(t: Tables):
    top = t.raw("nation").where(F.col("n_regionkey") < 3).agg(F.max("n_nationkey")).scalar()
    return _transit(t).line.select("name", "kind", "region", (F.col("id") > top).alias("is_new"))


@query("""SELECT CASE WHEN n_regionkey < 3 THEN lower(n_name) ELSE n_name END AS line, CASE WHEN n_regionkey < 3 AND
    s_acctbal > 0 THEN upper(s_name) ELSE s_name END AS station FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE (n_regionkey < 3 AND s_acctbal > 0) OR s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def transit_stations(t: Tables):
    result = _transit(t)
    names = result.line.select(F.col("id").alias("train_line_id"), F.col("name").alias("line"))
    return result.station.join(names, "train_line_id").select("line", F.col("name").alias("station"))


@query("""SELECT l_orderkey AS building_id, upper(s_name) AS station_key, arg_max(l_linenumber, CAST(l_linenumber AS BIGINT) * 1000000000
    + l_partkey) AS walking_minutes, count(*) FILTER (l_returnflag = 'R' AND n_regionkey < 3 AND s_acctbal > 0) > 0 AS was_stored
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def transit_links(t: Tables):
    result = _transit(t)
    names = result.station.select(F.col("id").alias("station_id"), F.upper("name").alias("station_key"))
    stored = F.col("id") == F.col("building_id") * 100_000 + F.col("station_id")
    return result.link.join(names, "station_id").select(
        "building_id", "station_key", "walking_minutes", (stored & (F.col("id") >= 0)).alias("was_stored")
    )


# --- metrics ---------------------------------------------------------------------------------------------------------


def _paged(t: Tables):
    """The classified batch with the page each listing was met on: fifty users to a page."""
    seen = latest_per_key(observed_batch(t), ["source_id"], [F.desc("ordinal")]).select("source_id", "section_type")
    page = (F.split_part("source_id", F.lit("-"), F.lit(1)).cast("long") / 10).cast("int") + 1
    return _listings(t).classified.join(seen, "source_id").select(
        "metric_status", F.col("section_type").alias("section_key"), page.alias("page")
    )


_PAGED = """SELECT CASE WHEN is_new THEN 'new' WHEN priced OR placed THEN 'updated' ELSE 'unchanged' END AS metric_status,
    b_section AS section_key, CAST(CAST(split_part(source_id, '-', 1) AS BIGINT) // 10 + 1 AS INTEGER) AS page
    FROM pairs WHERE NOT is_absent"""


@query(with_views("observation", """SELECT section_key, page, count(*) AS items,
    count(*) FILTER (metric_status = 'new') AS new_items, count(*) FILTER (metric_status = 'updated') AS updated_items,
    count(*) FILTER (metric_status = 'unchanged') AS unchanged_items, count(DISTINCT section_key || page) AS pages
    FROM paged GROUP BY ROLLUP (section_key, page)""", stored=_STORED, batch=_BATCH, steps=_STEPS, moved=_MOVED, pairs=_BOTH, paged=_PAGED))
def ingest_metrics(t: Tables):
    return metrics.ingest_metrics(_paged(t))


_QUIET = """SELECT user_id AS section_key, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS INTEGER) AS page,
    count(*) AS items, count(*) FILTER (event_type = 'signup') AS new_items, count(*) FILTER (event_type = 'purchase')
    AS updated_items FROM events GROUP BY 1, 2"""


_STOPS = """, ranked AS (SELECT *, row_number() OVER w AS n, CASE WHEN new_items + updated_items = 0 THEN 1 ELSE 0 END
    AS still FROM quiet WINDOW w AS (PARTITION BY section_key ORDER BY page)),
    pairs AS (SELECT section_key, page, CASE WHEN still = 1 AND lag(still) OVER (PARTITION BY section_key ORDER BY page) = 1
    THEN page END AS stop FROM ranked),
    stops AS (SELECT section_key, coalesce(min(stop), max(page)) AS stop_page, CASE WHEN min(stop) IS NULL THEN 'completed'
    ELSE 'caught-up' END AS stop_reason FROM pairs GROUP BY section_key)"""
_SUMMARIES = _STOPS + """, summaries AS (SELECT section_key, max(page) AS total_pages, section_key % 7 AS run_id,
    CAST(count(*) FILTER (page <= stop_page) AS INTEGER) AS pages_fetched,
    CAST(sum(items) FILTER (page <= stop_page) AS INTEGER) AS items_processed,
    CAST(sum(new_items) FILTER (page <= stop_page) AS INTEGER) AS new_items,
    CAST(sum(updated_items) FILTER (page <= stop_page) AS INTEGER) AS updated_items, any_value(stop_reason) AS stop_reason
    FROM quiet JOIN stops USING (section_key) GROUP BY section_key) """


def _days(t: Tables):
    return t.raw("events").groupBy(
        F.col("user_id").alias("section_key"),
        F.datediff("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).alias("page"),
    ).agg(
        F.count("*").alias("items"), F.count_if(F.col("event_type") == "signup").alias("new_items"),
        F.count_if(F.col("event_type") == "purchase").alias("updated_items"),
    )


@query(with_views("", """, ranked AS (SELECT *, row_number() OVER w AS n, CASE WHEN new_items + updated_items = 0 THEN 1 ELSE 0 END
    AS still FROM quiet WINDOW w AS (PARTITION BY section_key ORDER BY page)),
    pairs AS (SELECT section_key, page, CASE WHEN still = 1 AND lag(still) OVER (PARTITION BY section_key ORDER BY page) = 1
    THEN page END AS stop FROM ranked)
    SELECT section_key, coalesce(min(stop), max(page)) AS stop_page, CASE WHEN min(stop) IS NULL THEN 'completed'
    ELSE 'caught-up' END AS stop_reason FROM pairs GROUP BY section_key""", quiet=_QUIET))
def caught_up_pages(t: Tables):
    """Users as sections, days as pages: the first two days in a row without a signup or purchase end the section."""
    return metrics.caught_up_page(_days(t))


def _summaries(t: Tables):
    """A run has the users of one remainder by seven."""
    days = _days(t)
    sections = days.groupBy("section_key").agg(F.max("page").alias("total_pages")).withColumn("run_id", F.col("section_key") % 7)
    return metrics.section_summary(sections, days, metrics.caught_up_page(days))


@query(with_views("", _SUMMARIES + "SELECT * FROM summaries", quiet=_QUIET))
def section_summaries(t: Tables):
    return _summaries(t)


@query(with_views("", _SUMMARIES + """SELECT run_id, CAST(sum(items_processed) AS BIGINT) AS items, CAST(sum(pages_fetched) AS BIGINT)
    AS pages, CAST(sum(new_items) AS BIGINT) AS new_items, CAST(sum(updated_items) AS BIGINT) AS updated_items
    FROM summaries GROUP BY run_id""", quiet=_QUIET))
def run_totals(t: Tables):
    return metrics.run_totals(_summaries(t))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    THEN TIMESTAMP '2024-06-01' WHEN o_orderstatus = 'P' THEN o_orderdate END AS detail_fetched_at FROM orders""")
def fetched_listings(t: Tables):
    """Orders as listings; those with a returned line have been fetched again."""
    listings_ = t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("detail_fetched_at")
    )
    again = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return upserts.mark_fetched(listings_, again, F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00")))


@query(with_views("observation", """SELECT source_id, event_id, price FROM (SELECT *, lag(price) OVER w AS p, row_number()
    OVER w AS n FROM observation WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id)) WHERE n = 1 OR p <> price"""))
def rent_changes(t: Tables):
    """Change rows of units, whose first value counts as a change."""
    day = F.date_trunc("day", F.col("ts"))
    rows = listings.detect_changes(t.observation, "source_id", ["ts", "event_id"], ["price"], day, first=True)
    return rows.select("source_id", "event_id", "price")


# --- children, plans -------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS parent, l_linenumber AS sort_order, l_partkey AS value FROM lineitem WHERE l_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, o_custkey FROM orders
    WHERE o_orderstatus = 'P'""")
def replaced_children(t: Tables):
    children = t.raw("lineitem").select(
        F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("sort_order"), F.col("l_partkey").alias("value")
    )
    fresh = t.raw("orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("parent"), F.lit(0).alias("sort_order"), F.col("o_custkey").alias("value")
    )
    return upserts.replace_children(children, fresh, fresh, "parent")


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderpriority <> '5-LOW'""")
def cascade_deleted(t: Tables):
    gone = t.raw("orders").where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_orderkey").alias("id"))
    return upserts.cascade_delete(gone, t.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")


@query("""SELECT t.type, CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS province,
    n_regionkey || '-' || n_nationkey || '-' || t.type AS section_key FROM (SELECT DISTINCT o_orderpriority AS type FROM orders) t
    CROSS JOIN nation""")
def section_plan(t: Tables):
    types = t.raw("orders").select(F.col("o_orderpriority").alias("type")).distinct().withColumn("ord", F.ascii("type"))
    areas = t.raw("nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_regionkey").cast("string").alias("region"),
        F.col("n_nationkey").cast("string").alias("province"),
    )
    return page_source.section_plan(types, areas).drop("ord")


_SECTIONS = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '040' WHEN '2-HIGH' THEN '010' ELSE '021' END AS type,
    CAST(c_nationkey AS VARCHAR) AS province, CAST(count(*) * 37 AS INTEGER) AS total_items,
    CAST(max(month(o_orderdate)) AS INTEGER) AS scraped_pages
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


@query(with_views("", """SELECT type, province, CAST(p AS INTEGER) AS page, total_pages, CASE type
    WHEN '040' THEN 'https://listings.example/jj/chintai/ichiran/FR301FC001/?ar=099&bs=040&ta=' || province || '&page=' || p ||
    '&pc=50&po1=09&cb=0.0&ct=9999999&et=9999999&cn=9999999&mb=0&mt=9999999&shkr1=03&shkr2=03&shkr3=03&shkr4=03&fw2=&srch_navi=1'
    WHEN '010' THEN 'https://listings.example/jj/bukken/ichiran/JJ011FC001/?ar=099&bs=010&ta=' || province
    || '&po=1&pj=2&popj=12&pc=100&page=' || p
    ELSE 'https://listings.example/jj/bukken/ichiran/JJ012FC001/?ar=099&bs=021&ta=' || province || '&pn=' || p ||
    '&ekTjCd=&ekTjNm=&kb=1&kj=9&km=1&kt=9999999&tb=0&tj=0&tt=9999999&po=1&pj=2&pc=100' END AS url
    FROM (SELECT *, CAST(greatest(scraped_pages, ceil(total_items / CASE type WHEN '040' THEN 50.0 ELSE 100.0 END), 1)
    AS INTEGER) AS total_pages FROM sections), unnest(generate_series(1, total_pages)) AS u(p)""", sections=_SECTIONS))
def page_plan(t: Tables):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "040").when(F.col("o_orderpriority") == "2-HIGH", "010").otherwise("021")
    sections = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        kind.alias("type"), F.col("c_nationkey").cast("string").alias("province")
    ).agg((F.count("*") * 37).cast("int").alias("total_items"), F.max(F.month("o_orderdate")).alias("scraped_pages"))
    plan = page_source.page_plan(sections.withColumn("region", F.lit("099")), "https://listings.example")
    return plan.select("type", "province", "page", "total_pages", "url")


# --- odd input -------------------------------------------------------------------------------------------------------


@query(with_views("listing", """SELECT l.id, e.event_id, row_number() OVER (PARTITION BY l.id ORDER BY CASE WHEN e.value < 20 THEN NULL
    ELSE e.ts END NULLS FIRST, e.event_id) AS child_no FROM listing l JOIN events e ON l.id = e.user_id"""))
def children_without_time(t: Tables):
    """Events as children of listings; the cheap ones have no time and come first."""
    time = F.when(F.col("value") >= 20, F.col("ts"))
    child = t.raw("events").select(F.col("user_id").alias("listing_id"), "event_id", time.alias("at"))
    rows = with_children(t.listing.select("id"), child, "id", [F.asc("at"), F.asc("event_id")], F.to_date("at"), "listing_id")
    return rows.where(F.col("child_no").isNotNull()).select("id", "event_id", "child_no")


@query("""WITH line AS (SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation),
    stop AS (SELECT o_orderkey, n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT o_orderkey AS building_id, (SELECT min(id) FROM line WHERE name = n_name) AS train_line_id, c_mktsegment AS station FROM stop""")
def transit_equal_keys(t: Tables):
    """Stops of lines that are stored twice, in capitals and in small letters: the line of the very name gets them, once."""
    names = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    stored = conform(names.unionByName(names.select(F.col("id") + 100, F.lower("name")).toDF("id", "name")), "train_line")
    stops = t.raw("orders").join(t.places, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("building_id"), F.col("n_name").alias("line"), F.col("c_mktsegment").alias("station"),
        F.lit(5).alias("walking_minutes"), "region", F.col("o_orderkey").alias("ordinal"),
    )
    none = lambda name: conform(t.spark.createDataFrame([], "id long"), name)
    done = upserts.upsert_transit(stops, stored, none("station"), none("building_station"), _as_of())
    named = done.station.select(F.col("id").alias("station_id"), F.col("name").alias("station"), "train_line_id")
    return done.link.join(named, "station_id").select("building_id", F.col("train_line_id"), "station")
