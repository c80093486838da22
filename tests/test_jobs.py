"""Table-to-table jobs on small hand-made tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from estatelake.operators import buildings, counts, filters, lines, listings, metrics, ordered, rentals, translations, upserts
from estatelake.plans.ingest import ingest_rentals, ingest_sales
from estatelake.plans.resolution import propose_lines
from estatelake.plans.search import listing_search, rental_search
from estatelake.sources import canonical, dims, fixtures, pages, plan_files, tables
from estatelake.session import shared_folder

T0, T1, T2 = (dt.datetime(2026, 1, d) for d in (1, 2, 3))
AT = lambda t: F.lit(t).cast("timestamp")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


LISTING = "id long, source_id string, section_type string, property_type string, region string, province string, price long, price_text string, last_updated timestamp"
BATCH = "source_id string, section_type string, property_type string, region string, province string, price long, price_text string, ordinal int"


def sale_case(spark):
    stored = spark.createDataFrame(
        [(1, "A", "021", "x", "030", "13", 10, "10", T0), (2, "B", None, "x", "030", "13", 20, "20", T0), (3, "C", "021", "x", "030", "13", 30, None, T0)], LISTING
    )
    batch = spark.createDataFrame(
        [("A", "021", "y", "030", "13", 8, "8", 0), ("A", "021", "y", "030", "13", 9, "9", 1), ("B", "021", "y", "030", "13", 20, "20", 2),
         ("C", "021", "y", "030", "13", 30, "", 3), ("D", "021", "y", "030", "13", 40, "40", 4)], BATCH,
    )
    return stored, batch


def test_sale_upsert(spark):
    stored, batch = sale_case(spark)
    done = upserts.upsert_listings(stored, batch, AT(T1))
    assert rows(done.snapshot, "source_id", "id", "price", "section_type", "property_type", "last_updated") == [
        ("A", 1, 9, "021", "y", T1), ("B", 2, 20, "021", "y", T0), ("C", 3, 30, "021", "x", T0), ("D", 4, 40, "021", "y", T1),
    ]
    assert rows(done.history, "property_id", "price", "price_text", "recorded_at") == [(1, 8, "8", T1), (1, 9, "9", T1)]
    assert rows(done.classified, "source_id", "metric_status", "write_status") == [
        ("A", "updated", "price"), ("B", "unchanged", "place"), ("C", "unchanged", "keep"), ("D", "new", "insert"),
    ]
    assert upserts.repeated_keys(batch, "source_id").first()[0] == 1


def test_sale_upsert_twice_adds_nothing_and_baseline_logs_new(spark):
    stored, batch = sale_case(spark)
    first = upserts.upsert_listings(stored, batch, AT(T1))
    again = upserts.upsert_listings(first.snapshot, batch.where("ordinal > 0"), AT(T2))
    assert again.history.count() == 0
    assert rows(again.snapshot, *stored.columns) == rows(first.snapshot, *stored.columns)
    assert upserts.upsert_listings(stored, batch, AT(T1), baseline=True).history.count() == 3


def test_unit_upsert(spark):
    unit = "id long, source_id string, building_id long, rent long, rent_text string, management_fee long, insert_date timestamp, last_updated timestamp"
    stored = spark.createDataFrame([(1, "U1", 7, 5, "5", 1, T0, T0), (2, "U2", 7, 6, "6", 1, T0, T0)], unit)
    batch = spark.createDataFrame(
        [("U1", "building-9", 4, "4", 1, 0), ("U2", "building-9", 6, "6", 2, 1), ("U3", "building-9", 7, "7", 3, 2), ("U4", "building-", 7, "7", 3, 3)],
        "source_id string, building_key string, rent long, rent_text string, management_fee long, ordinal int",
    )
    owners = spark.createDataFrame([(9, "building-9")], "id long, source_id string")
    done = upserts.upsert_units(stored, batch, owners, AT(T1))
    assert rows(done.snapshot, "source_id", "building_id", "rent", "management_fee", "last_updated") == [
        ("U1", 7, 4, 1, T1), ("U2", 7, 6, 1, T0), ("U3", 9, 7, 3, T1),
    ]
    assert rows(done.history, "rental_unit_id", "rent") == [(1, 4), (3, 7)]


def test_rekeyed_building_takes_the_listed_key(spark):
    stored = spark.createDataFrame([(1, "U1"), (2, "building-8"), (3, "U5")], "id long, source_id string")
    units = spark.createDataFrame([(1, "U1", 1), (2, "U2", 1), (3, "U5", 3)], "id long, source_id string, building_id long")
    batch = spark.createDataFrame([("U1", "building-7"), ("U2", "building-7"), ("U5", "building-8")], "source_id string, building_key string")
    assert rows(upserts.rekey_buildings(batch, units, stored), "id", "source_id") == [(1, "building-7"), (2, "building-8"), (3, "U5")]


def test_caught_up(spark):
    changes = [3, 0, 1, 0, 0, 2]
    found = spark.createDataFrame(
        [("s", p, 5, n, 0) for p, n in enumerate(changes, 1)] + [("e", 1, 5, 1, 0), ("e", 2, 0, 0, 0)] + [("c", 1, 5, 1, 0), ("c", 2, 5, 0, 0)],
        "section_key string, page int, items long, new_items long, updated_items long",
    )
    assert rows(metrics.caught_up_page(found), "section_key", "stop_page", "stop_reason") == [
        ("c", 2, "completed"), ("e", 2, "no-items"), ("s", 5, "caught-up"),
    ]
    stops = metrics.caught_up_page(found)
    sections = spark.createDataFrame([("s", 6)], "section_key string, total_pages int")
    assert rows(metrics.section_summary(sections, found, stops), "pages_fetched", "items_processed", "new_items", "stop_reason") == [(5, 25, 4, "caught-up")]


def test_line_merge(spark):
    line = spark.createDataFrame([(1, "X", "c", "Y"), (2, "Y", "c", "Y"), (3, "Z", "c", "Y"), (4, "W", None, None)], "id long, name string, canonical_id string, canonical_name string")
    station = spark.createDataFrame([(10, "s", 1), (20, "t", 2), (30, "s", 3), (31, "t", 3), (40, "s", 4)], "id long, name string, train_line_id long")
    link = spark.createDataFrame([(1, 100, 10, 5), (2, 100, 30, 6), (3, 101, 31, 7), (4, 101, 20, 8), (5, 102, 40, 9)], "id long, building_id long, station_id long, walking_minutes int")
    done = lines.merge_lines(line, station, link)
    assert rows(done.line, "id") == [(2,), (4,)]
    assert rows(done.station, "id", "name", "train_line_id") == [(10, "s", 2), (20, "t", 2), (40, "s", 4)]
    assert rows(done.link, "id", "building_id", "station_id", "walking_minutes") == [(1, 100, 10, 5), (4, 101, 20, 8), (5, 102, 40, 9)]
    again = lines.merge_lines(done.line, done.station, done.link)
    assert again.plan.count() == 0 and rows(again.link, *link.columns) == rows(done.link, *link.columns)


def test_building_verdicts_and_plan(spark):
    index = buildings.unit_key_index(
        spark.createDataFrame(
            [("U1", "B1"), ("U2", "B1"), ("U3", "B1"), ("U4", "B2"), ("U7", "B4"), ("U7", "B5")], "unit_key string, building_key string"
        )
    )
    held = {1: ["U1", "U2"], 2: [], 3: ["U1", "UX"], 4: ["U1", "U4"], 5: ["U7"], 6: ["U7", "UX"], 7: ["U3"]}
    stored = spark.createDataFrame([(i, f"n{i}") for i in held], "id long, source_id string")
    units = spark.createDataFrame([(u + ("" if i != 3 else ""), i) for i, us in held.items() for u in us], "source_id string, building_id long")
    verdicts = buildings.classify_buildings(stored, units, index)
    assert rows(verdicts, "building_id", "verdict", "building_key") == [
        (1, "merge", "B1"), (2, "no-units", None), (3, "uncovered-unit", None), (4, "mixed-buildings", None),
        (5, "ambiguous-unit", None), (6, "ambiguous-unit", None), (7, "merge", "B1"),
    ]
    plan = buildings.merge_plan(verdicts, stored)
    assert rows(plan, "building_key", "keep_id", "source_id", "unit_count") == [("B1", None, 1, 2), ("B1", None, 7, 1)]
    links = spark.createDataFrame([(1, 1, 5, 1), (2, 7, 5, 2), (3, 7, 6, 3)], "id long, building_id long, station_id long, walking_minutes int")
    done = buildings.apply_building_merges(plan, index, stored, units, links)
    assert rows(done.building.where("id = 1"), "source_id") == [("B1",)] and done.building.where("id = 7").count() == 0
    assert rows(done.link, "id", "building_id") == [(1, 1), (3, 1)]
    assert rows(done.outcome, "outcome", "rows_removed", "units_moved", "stations_moved", "stations_dropped") == [("merged", 1, 1, 1, 1)]
    later = buildings.apply_building_merges(plan, index, stored.where("id <> 7"), units, links)
    assert rows(later.outcome, "outcome", "rows_removed") == [("changed", 0)]


def test_candidates_match_brute_force(spark):
    def grams(s):
        return {s[i : i + 2] for i in range(len(s) - 1)} or ({s} if s else set())

    def score(n, t):
        a, b = grams(n), grams(t)
        best = 1.0 if n == t else 2 * len(a & b) / (len(a) + len(b))
        return max(best, 0.85 if n in t else 0, 0.8 if t in n else 0)

    names = ["中央線", "JR中央線", "央", "線", "銀座線", "京", "abc", "銀"]
    targets = ["中央線", "京", "東京メトロ銀座線", "線", "xyz", "央線"]
    n = spark.createDataFrame([(x,) for x in names], "norm string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    got = {(r["norm"], r["target"]): round(r["score"], 9) for r in lines.name_pairs(n, t).collect()}
    want = {(a, b): round(score(a, b), 9) for a in names for b in targets if score(a, b) > 0}
    assert got == want


@pytest.mark.parametrize("hot", [1, 3, 16])
def test_hot_pieces_make_no_pairs_and_lose_no_candidate(spark, hot):
    """One bigram is in every name and target; names inside targets and targets inside names, single characters, ties."""
    draw = random.Random(hot)
    text = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(0, 6)))
    names = {text() + "qz" + text() for _ in range(60)} | {"q", "z", "a", "qz", "zz", "none"}
    forms = [[text() + "qz" + text(), text() + "qz"] for _ in range(40)] + [["qz", "q"], ["zq", "qz"], ["a", "zqzqz"]]
    raw = [(i, "", f"c{i}", f[0], f[1], "", [], [str(i % 5)]) for i, f in enumerate(forms)]
    canon = canonical.merge_canonical(spark.createDataFrame(raw, tables.TABLES["canonical_line"]))
    wanted = spark.createDataFrame([(n, r) for n in sorted(names) for r in ("0", "1", None)], "name string, region string")
    areas = spark.createDataFrame([(str(i), str(i % 2)) for i in range(5)], "province string, region string")
    got = lines.line_candidates(wanted, canon, 7, areas, hot)

    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}

    def score(n, t):
        dice = 1.0 if n == t else 2 * len(grams(n) & grams(t)) / (len(grams(n)) + len(grams(t)))
        return max(dice, 0.85 if n in t else 0, 0.8 if t in n else 0)

    want = set()
    for n in names:
        for r in ("0", "1", None):
            scores = [(max(score(n, t) for t in f), i) for i, f in enumerate(forms)]
            best = sorted((-(s + 0.05 * (str(i % 5 % 2) == r)), i) for s, i in scores if s > 0)[:7]
            want |= {(n, r, f"c{i}", round(-s, 9), at) for at, (s, i) in enumerate(best, 1)}
    assert {(x.name, x.region, x.ekidata_id, round(x.score, 9), x["rank"]) for x in got.select("*").collect()} == want


def test_numbers_over_very_many_ranges(spark):
    """A million ranges: totals run inside groups of ranges and over the groups, and equal keys are told apart by all columns."""
    n = 1_000_000
    rows_ = spark.range(n).select((F.col("id") * 3).alias("id"), F.lit("x").alias("text"))
    got = ordered.numbered(rows_, F.col("id"), ["id"], "at", parts=16)
    assert got.where(F.col("at") != F.col("id") / 3 + 1).count() == 0 and got.count() == n
    tied = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (None, "c", 1), (1, "a", 3), (7, None, 0)], "id long, text string, v int")
    got = translations.assign_batches(tied.repartition(5), size=2, width=3)
    assert rows(got, "id", "text", "v", "batch") == sorted(
        [(None, "c", 1, 0), (1, "a", 3, 0), (1, "a", 9, 1), (1, "b", 2, 1), (7, None, 0, 2)], key=repr
    )


def test_line_proposals_with_a_decider(spark):
    raw = spark.createDataFrame(
        [(0, "a", "1", "山手線", "やまのてせん", "Yamanote", [], ["13"]), (1, "", "2", "中央線", "", "", ["JR中央線"], ["13", "20"]), (2, "c", "2", "中央線", "", "Chuo", ["中央本線"], ["13"])],
        tables.TABLES["canonical_line"],
    )
    merged = canonical.merge_canonical(raw)
    assert rows(merged, "ekidata_id", "code", "name_romaji", "alternative_names", "prefectures") == [
        ("1", "a", "Yamanote", [], ["13"]), ("2", "c", "Chuo", ["JR中央線", "中央本線"], ["13", "20"]),
    ]
    line = spark.createDataFrame(
        [(1, "ＪＲ中央線", None, None, "030", "unknown", None, None), (2, "小72", "Ko 72", None, "030", "unknown", None, None)], tables.TABLES["train_line"]
    )
    decide = lambda asked: asked.select("name", "region", F.format_string('{"kind":"rail","canonical_id":"%s"}', F.col("candidates")[0]["ekidata_id"]).alias("reply"))
    found = propose_lines(line, merged, dims.prefectures(spark), decide)
    assert rows(found, "id", "new_kind", "new_canonical_id", "new_canonical_name", "clear_bus_name") == [(1, "rail", "2", "Chuo", False), (2, "bus", None, None, True)]
    assert rows(lines.apply_proposals(line, found), "id", "kind", "translated_name") == [(1, "rail", None), (2, "bus", None)]


def test_proposal_page(spark):
    found = spark.createDataFrame([(3, False), (1, True), (2, False), (4, True)], "id long, changed boolean")
    order = lambda page, size=50: [r["id"] for r in listings.proposal_page(found, page, size).collect()]
    assert order(1) == [1, 4, 2, 3]
    assert order(2, 3) == [3] and order(99, 3) == [3] and order(0, 3) == [1, 4, 2] and order(None, 3) == [1, 4, 2] and order(-3, 3) == [1, 4, 2]
    assert listings.proposal_page(found.limit(0), 4).count() == 0


def test_due_for_refresh(spark):
    now = dt.datetime(2026, 11, 18, 12)
    ago = lambda **k: now - dt.timedelta(**k)
    listing = spark.createDataFrame(
        [(1, None), (2, ago(days=7, seconds=-1)), (3, ago(days=7, seconds=1)), (4, None), (5, None), (6, None), (7, None)], "id long, detail_fetched_at timestamp"
    )
    request = spark.createDataFrame(
        [(4, "queued", now), (5, "running", now), (6, "failed", ago(hours=1, seconds=-1)), (7, "failed", ago(hours=1, seconds=1))], "property_id long, status string, requested_at timestamp"
    )
    assert rows(filters.due_for_refresh(listing, request, AT(now)), "id") == [(1,), (3,), (7,)]


def test_counts(spark):
    units = spark.createDataFrame([(b,) for b, n in ((1, 5), (2, 2), (3, 9)) for _ in range(n)], "building_id long")
    stored = spark.createDataFrame([(1, "13", "13101"), (2, "13", "13102"), (3, "27", "27001")], "id long, region string, province string")
    nested = {r["region"]: r["provinces"] for r in counts.as_nested(counts.rental_counts(units, stored)).collect()}
    assert nested == {"13": {"13101": 5, "13102": 2}, "27": {"27001": 9}}
    typed = spark.createDataFrame([("021",)] * 4 + [("011",)] + [(None,)] * 3, "section_type string")
    assert rows(counts.listing_totals(typed, units), "section_type", "listings") == [("011", 1), ("021", 4), ("040", 16)]
    assert dims.prefectures(spark).count() == 47 and pages.default_section_plan(spark).count() == 282
    assert pages.default_section_plan(spark, type="021", province="13").count() == 1
    assert rows(counts.run_stats(spark.createDataFrame([], "status string")), "total", "success_rate") == [(0, 0)]


def test_previous_values_do_not_depend_on_slices(spark):
    data = [(k, i, (i * 7 + k) % 5) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i int, v int")
    whole = ordered.with_previous(df, ["k"], ["i"], ["v"], F.lit(0))
    cut = ordered.with_previous(df, ["k"], ["i"], ["v"], F.floor(F.col("i") / 7))
    assert rows(whole, "k", "i", "previous.v") == rows(cut, "k", "i", "previous.v")
    assert {r["n"] for r in ordered.numbered(df, F.floor(F.col("i") / 9), ["i", "k"], "n").collect()} == set(range(1, 121))


def test_hot_key_keeps_every_change(spark):
    """One key with a third of all rows gives the same changes as a plain pass over its rows in order."""
    hot = [(0, i, (i // 3) % 4) for i in range(300)] + [(k, i, k) for k in range(1, 61) for i in range(10)]
    df = spark.createDataFrame(hot, "k int, i int, v int")
    found = listings.detect_changes(df, "k", ["i"], ["v"], F.floor(F.col("i") / 10), first=True)
    assert found.count() == 100 + 60


def test_batches_and_translations(spark):
    df = spark.createDataFrame([(i,) for i in range(120)], "id long")
    per = translations.assign_batches(df, 50, width=7).groupBy("batch").count()
    assert rows(per, "batch", "count") == [(0, 50), (1, 50), (2, 20)]
    cache = spark.createDataFrame([("a", "A")], "source_text string, translated_text string")
    shown = translations.decorate(spark.createDataFrame([("a",), ("b",), (None,), ("",)], "t string"), ["t"], cache)
    assert rows(shown, "t") == [("-",), ("-",), ("A",), ("b",)]


def test_tables_round_trip_and_plan_file(spark, tmp_path):
    root = str(tmp_path)
    made = fixtures.make_fixture(spark, 94, 470, 470)
    tables.write_table(made["listing"], root, "listing", 1)
    tables.write_table(made["listing"].where("id < 10"), root, "listing", 2)
    assert tables.versions(spark, root, "listing") == [1, 2] and tables.read_table(spark, root, "listing").count() == 9
    assert tables.read_table(spark, root, "listing", 1).select("province").distinct().count() == 47
    assert made["rental_unit"].groupBy("building_id").count().agg(F.max("count")).first()[0] == 5
    assert tables.read_table(spark, root, "building").count() == 0 and tables.read_log(spark, root, "price_history").count() == 0
    old = spark.createDataFrame([(1, "2025-03-01", "x")], "id long, insert_date string, gone string")
    assert tables.conform(old, "building", {"address": "-"}).select("insert_date", "address").first()[1] == "-"
    plan_files.write_plan(old, f"{root}/plan", "db1")
    assert plan_files.read_plan(spark, f"{root}/plan", "db1").count() == 1
    with pytest.raises(ValueError):
        plan_files.read_plan(spark, f"{root}/plan", "db2")
    with pytest.raises(ValueError):
        plan_files.read_plan(spark, f"{root}/plan", "db1", spark.createDataFrame([("running",)], "status string"))
    assert shared_folder(spark)


def test_ingest_jobs_end_to_end(spark):
    from test_pages import BOX, RENTAL, SITE, sale

    url = "https://site.example/list?ar=030&bs={}&ta=13&page=1"
    page = lambda html, kind: spark.createDataFrame([(1, url.format(kind), html)], "page_id long, url string, html string")
    empty = page("", "010")
    none = lambda name: spark.createDataFrame([], tables.TABLES[name])
    done = ingest_sales(none("listing"), page(sale('<input name="bsnc" value="A">', BOX), "011"), empty, SITE, AT(T1))
    assert rows(done.tables["listing"], "source_id", "section_type", "property_type", "region", "province", "building_area") == [("A", "011", "中古マンション", "030", "13", 50.45)]
    assert rows(done.classified.where("item"), "source_id", "section_key", "metric_status") == [("A", "030-13-011", "new")]
    assert rows(done.classified.where("NOT item"), "section_key", "metric_status") == [("030-13-010", None)]
    names = ("building", "rental_unit", "train_line", "station", "building_station")
    rented = ingest_rentals({n: none(n) for n in names}, page(RENTAL, "040"), SITE, AT(T1))
    assert rows(rented.tables["building"], "source_id", "title") == [("building-100426191626", "A")]
    assert rows(rented.tables["rental_unit"], "source_id", "rent") == [("U1", 61_000), ("U2", 0)]
    assert rows(rented.tables["train_line"], "name", "kind") == [("地下鉄南北線", "unknown")]
    assert rows(rented.tables["building_station"], "walking_minutes") == [(24,)]
    assert rented.logs["rental_price_history"].count() == 2
    found = rental_search(rented.tables, {"region": "030", "province": "13"}, min_rent=1)
    assert rows(found.buildings, "title") == [("A",)] and rows(found.units, "source_id") == [("U1",)]
    assert rows(found.lines, "label", "buildings") == [("地下鉄南北線", 1)] and found.unit_total.first()[0] == 1
    assert listing_search(done.tables["listing"], done.logs["price_history"], {"section_type": "011"}).count() == 1


def test_listing_options(spark):
    df = spark.createDataFrame(
        [(1, 29_999_999, 60.0, 1.0, 10), (2, 30_000_000, 0.0, 60.0, 0), (3, 60_000_000, 59.0, 99.0, 11)], "id long, price long, building_area double, area double, walking_minutes int"
    )
    ids = lambda **o: [r[0] for r in df.where(filters.listing_condition(**o)).select("id").orderBy("id").collect()]
    assert ids(price="30to60") == [2] and ids(size="60") == [1, 2] and ids(walk="10") == [1] and ids(price="zzz", size="7", walk="x") == [1, 2, 3]
    assert not filters.has_active_filters() and filters.has_active_filters(walk="5") and not filters.has_active_filters(price="zzz")
    assert rentals.filter_units is filters.filter_units


def test_canonical_file_and_observed_counters(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('[{"ekidata_id":"7","name_kanji":"a","prefectures":["13"]},{"ekidata_id":"","name_kanji":"b"},{"ekidata_id":"8","name_kanji":"c"}]')
    found = canonical.read_canonical_lines(spark, str(path))
    assert rows(found, "ekidata_id", "name_kanji") == [("7", "a"), ("8", "c")]
    seen = Observation("ingest")
    classified = spark.createDataFrame([("new",), ("new",), ("updated",)], "metric_status string")
    metrics.observed(classified, seen).write.mode("overwrite").parquet(str(tmp_path / "out"))
    assert (seen.get["items"], seen.get["new_items"], seen.get["updated_items"], seen.get["unchanged_items"]) == (3, 2, 1, 0)


def test_children_are_numbered_across_slices(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, i) for i in range(25)], "property_id long, i int")
    got = listings.with_children(parent, child, "id", [F.asc("i")], F.floor(F.col("i") / 4), "property_id")
    assert rows(got.where("id = 1"), "i", "child_no") == sorted(((i, i + 1) for i in range(25)), key=repr)
    assert rows(got.where("id = 2"), "child_no") == [(None,)]
