"""Rows that odd input used to lose: each case holds the smallest input that shows it."""

import datetime as dt

from pyspark.sql import functions as F
from test_jobs import AT, BATCH, LISTING, T0, T1, rows
from test_pages import BOX, SITE, pages, sale

from estatelake.operators import cards, lines, listings, metrics, upserts
from estatelake.plans.ingest import ingest_sales
from estatelake.sources import pages as page_source
from estatelake.sources import tables
from estatelake.streaming.ingest import stream_pages, stream_upsert

def test_facts_behind_comments_and_texts(spark):
    from estatelake.fixed_values import DETAIL_LABEL_CLASSES

    th = f'<th class="{DETAIL_LABEL_CLASSES[0]}">'
    html = f"<table><tr>{th}A</th><td>one</td></tr><tr>{th}B</th>\n<!-- c -->\n<!-- d -->\n<!-- e --> x <td>two</td></tr><tr>{th}C</th></tr><tr><td>no</td></tr></table>"
    assert rows(cards.extract_detail_facts(pages(spark, html)), "label", "value") == [("A", "one"), ("B", "two")]


def test_sections_have_all_their_pages(spark):
    section = spark.createDataFrame([("021", "030", "13", 612_345, 2)], "type string, region string, province string, total_items int, scraped_pages int")
    assert page_source.page_plan(section, SITE).count() == 6124
    cut = page_source.page_plan(section, SITE, max_pages=10)
    assert cut.count() == 10 and cut.first()["pages_left_out"] == 6114


def test_children_without_an_order_value(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, T0, "a"), (1, None, "b"), (1, None, "c")], "property_id long, at timestamp, name string")
    got = listings.with_children(parent, child, "id", [F.asc("at"), F.asc("name")], F.to_date("at"), "property_id")
    assert rows(got, "id", "name", "child_no") == [(1, "a", 3), (1, "b", 1), (1, "c", 2), (2, None, None)]


def test_every_step_of_a_batch_is_logged(spark):
    stored = spark.createDataFrame([(1, "A", "021", "x", "030", "13", 10, "10", T0)], LISTING)
    batch = spark.createDataFrame(
        [("A", "021", "x", "030", "13", p, str(p), i) for i, p in enumerate((8, 8, 12, 10))] + [("N", "021", "x", "030", "13", p, str(p), i) for i, p in enumerate((5, 6))], BATCH,
    )
    done = upserts.upsert_listings(stored, batch, AT(T1))
    assert rows(done.history, "property_id", "price") == [(1, 10), (1, 12), (1, 8), (2, 6)]
    assert rows(done.snapshot, "source_id", "price", "last_updated") == [("A", 10, T1), ("N", 6, T1)]
    assert rows(done.sightings, "source_id", "ordinal", "metric_status") == [
        ("A", 0, "updated"), ("A", 1, "unchanged"), ("A", 2, "updated"), ("A", 3, "updated"), ("N", 0, "new"), ("N", 1, "updated"),
    ]


def test_lines_without_a_reply_are_proposed(spark):
    line = spark.createDataFrame(
        [(1, "JR山手線", "030", "rail", None, None), (2, "都営バス", "030", "unknown", None, "Bus"), (3, "x線", "030", "rail", "7", None)],
        "id long, name string, region string, kind string, canonical_id string, translated_name string",
    ).withColumn("canonical_name", F.lit(None).cast("string"))
    decided = spark.createDataFrame([("JR山手線", "030", "rail", "5", "Yamanote")], "name string, region string, kind string, canonical_id string, canonical_name string")
    assert rows(lines.propose(line, decided), "id", "new_kind", "new_canonical_id", "clear_bus_name", "changed") == [
        (1, "rail", "5", False, True), (2, "bus", None, True, True), (3, "rail", "7", False, False),
    ]


def test_stored_lines_of_one_key_get_one_station_and_link(spark):
    none = lambda name: spark.createDataFrame([], tables.TABLES[name])
    line = spark.createDataFrame(
        [(1, "ＪＲ中央線", None, None, "030", "rail", None, None), (2, "JR中央線", None, None, "030", "rail", None, None)], tables.TABLES["train_line"]
    )
    station = spark.createDataFrame([(5, "新宿", None, 2), (6, "新宿", None, 2)], tables.TABLES["station"])
    stops = spark.createDataFrame([(9, "JR中央線", "新宿", 4, "030", 0), (9, "ｊｒ中央線", "中野", 7, "030", 1)], "building_id long, line string, station string, walking_minutes int, region string, ordinal int")
    done = upserts.upsert_transit(stops, line, station, none("building_station"), AT(T1))
    assert done.line.count() == 2
    assert rows(done.station, "name", "train_line_id") == [("中野", 1), ("新宿", 2), ("新宿", 2)]
    assert rows(done.link, "building_id", "station_id", "walking_minutes") == [(9, 5, 4), (9, 7, 7)]


def _page(spark, folder, number, url, *ids):
    html = "".join(sale(f'<input name="bsnc" value="{i}">', BOX) for i in ids)
    rows = [(number, url, "property-list", html)]
    spark.createDataFrame(rows, tables.TABLES["page"]).coalesce(1).write.mode("append").parquet(folder)


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    root, url = str(tmp_path), SITE + "/list?ar=030&bs=011&ta=13&pn={}"
    run = lambda pages, state: stream_upsert(stream_pages(spark, f"{root}/{pages}"), f"{root}/tables", SITE, f"{root}/{state}", lambda n: AT(T1)).awaitTermination()
    _page(spark, f"{root}/p1", 1, url.format(1), "A", "B")
    _page(spark, f"{root}/p1", 2, None, "X")
    run("p1", "s1")
    _page(spark, f"{root}/p2", 3, url.format(2), "C")
    run("p2", "s2")
    assert rows(tables.read_table(spark, f"{root}/tables", "listing"), "source_id") == [("A",), ("B",), ("C",)]
    assert rows(tables.read_log(spark, f"{root}/tables", "page_reject"), "page_id") == [(2,)]
    assert len(set(rows(tables.read_log(spark, f"{root}/tables", "ingest_commit"), "version"))) == 2


def test_pages_count_empty_and_repeated_items(spark):
    url = SITE + "/list?ar=030&bs=011&ta=13&pn={}"
    html = ["".join(sale(f'<input name="bsnc" value="{i}">', BOX) for i in ids) for ids in (["A", "B"], ["A"], [])]
    frame = spark.createDataFrame([(i, url.format(i + 1), h) for i, h in enumerate(html)], "page_id long, url string, html string")
    none = spark.createDataFrame([], tables.TABLES["listing"])
    done = ingest_sales(none, frame, frame.limit(0), SITE, AT(T1))
    got = metrics.page_metrics(done.classified)
    assert rows(got, "page", "items", "new_items", "updated_items", "unchanged_items") == [(1, 2, 2, 0, 0), (2, 1, 0, 0, 1), (3, 0, 0, 0, 0)]
    stops = metrics.caught_up_page(got)
    assert rows(stops, "stop_page", "stop_reason") == [(3, "no-items")]
    assert dt.date(2026, 1, 2) == done.tables["listing"].first()["insert_date"]


def test_rows_without_order_or_key(spark):
    """A row without an ordinal counts as the key's first, equal ordinals have one order, and rows without a key are set apart."""
    stored = spark.createDataFrame([(1, "A", "021", "x", "030", "13", 10, "10", T0)], LISTING)
    row = lambda key, price, at: (key, "021", "x", "030", "13", price, str(price), at)
    batch = spark.createDataFrame(
        [row("A", 8, None), row("N", 5, None), row("B", 4, 0), row("B", 3, 0), row(None, 9, 1), row(None, 8, None), row("A", 9, 4), row("A", 8, None)], BATCH
    )
    for frame in (batch, batch.repartition(5), batch.coalesce(1)):
        done = upserts.upsert_listings(stored, frame, AT(T1))
        assert rows(done.snapshot, "source_id", "price") == [("A", 9), ("B", 4), ("N", 5)]
        named = done.history.join(done.snapshot.select(F.col("id").alias("property_id"), "source_id"), "property_id")
        assert rows(named, "source_id", "price") == [("A", 8), ("A", 9), ("B", 4)]
        assert rows(done.rejected, "price") == [(8,), (9,)] and done.sightings.count() == 6
        assert rows(done.changes.select("before.price", F.col("after.price").alias("to")), "price", "to") == [(10, 9), (None, 4), (None, 5)]
    unordered = upserts.upsert_listings(stored, batch.drop("ordinal"), AT(T1))
    assert rows(unordered.snapshot, "source_id", "price") == [("A", 9), ("B", 4), ("N", 5)]


def test_units_without_order_or_key(spark):
    stored = spark.createDataFrame([(1, "U", 4, 100)], "id long, source_id string, building_id long, rent long").selectExpr("*", "CAST(NULL AS timestamp) AS last_updated")
    batch = spark.createDataFrame([("U", "building-1", 90, None), ("V", "building-1", 50, None), (None, "building-1", 1, 2), ("W", None, 7, 1)], "source_id string, building_key string, rent long, ordinal int")
    owners = spark.createDataFrame([(4, "building-1")], "id long, source_id string")
    done = upserts.upsert_units(stored, batch, owners, AT(T1))
    assert rows(done.snapshot, "source_id", "rent") == [("U", 90), ("V", 50)]
    assert rows(done.history, "rental_unit_id", "rent") == [(1, 90), (2, 50)] and done.rejected.count() == 1


def test_names_of_stops_find_their_rows_without_the_buildings(spark):
    none = lambda name: spark.createDataFrame([], tables.TABLES[name])
    stops = spark.createDataFrame(
        [(1, "L", "S", 5, "010", 1), (1, "L", "S", 7, "010", 4), (2, "Ｌ", "s", 3, "020", 2), (2, "L", "S", 9, "010", 3), (3, None, "S", 1, "010", 0)],
        "building_id long, line string, station string, walking_minutes int, region string, ordinal long",
    )
    done = upserts.upsert_transit(stops, none("train_line"), none("station"), none("building_station"), AT(T1))
    assert rows(done.line, "name", "region") == [("L", "010")] and rows(done.station, "name") == [("S",)]
    assert rows(done.link, "building_id", "walking_minutes") == [(1, 7), (2, 9)]
    assert "line_key" not in done.link._jdf.queryExecution().optimizedPlan().toString()


def test_links_meet_their_merged_stations_in_one_join(spark):
    line = spark.createDataFrame([(1, "A", "7", "A"), (2, "a", "7", "A"), (3, "B", None, None)], "id long, name string, canonical_id string, canonical_name string")
    station = spark.createDataFrame([(11, "S", 1), (21, "S", 2), (22, "T", 2), (31, "S", 3)], "id long, name string, train_line_id long")
    link = spark.createDataFrame(
        [(1, 5, 11, 4), (2, 5, 21, 3), (3, 5, 22, 2), (4, 5, 31, 1), (5, 6, 31, 9), (6, 6, 31, 8), (7, 7, 99, 6)],
        "id long, building_id long, station_id long, walking_minutes int",
    ).repartition(2)
    done = lines.merge_lines(line, station, link)
    kept = [(1, 5, 11, 4), (3, 5, 22, 2), (4, 5, 31, 1), (5, 6, 31, 9), (6, 6, 31, 8), (7, 7, 99, 6)]
    assert sorted(map(tuple, done.link.select("id", "building_id", "station_id", "walking_minutes").collect())) == kept
    plan = done.link._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition 2") == 1
