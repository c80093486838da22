"""Stored tables that micro-batches keep up to date: what is written, what stays, and batches that are repeated."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_jobs import AT, T1, T2, rows
from test_no_losses import _page
from test_pages import BOX, RENTAL, SITE, sale

from estatelake.operators.counts import refresh_counts
from estatelake.sources import tables
from estatelake.streaming import ingest
from estatelake.streaming.ingest import stream_pages, stream_upsert, upsert_batch

URL = SITE + "/list?ar=030&bs={}&ta=13&pn={}"


def files(root, name):
    return {(d, f) for d, _, found in os.walk(f"{root}/{name}") for f in found if f.startswith("part-")}


def card(key, price):
    priced = f'<div class="dottable"><div class="dottable-line"><dl><dt>販売価格</dt><dd><span class="dottable-value">{price}万円</span></dd></dl></div></div>'
    return sale(f'<input name="bsnc" value="{key}">', priced + BOX)


def page_rows(spark, *pages):
    return spark.createDataFrame([(i, url, "property-list", html) for i, (url, html) in enumerate(pages)], tables.TABLES["page"])


@pytest.fixture
def store(spark, tmp_path):
    """Root of the tables and a function that runs one batch."""
    root = str(tmp_path / "tables")
    os.makedirs(tmp_path / "state")
    (tmp_path / "state" / "metadata").write_text(json.dumps({"id": "q"}))
    run = upsert_batch(root, SITE, lambda n: AT(T1 if n == 0 else T2), str(tmp_path / "state"), 8)
    return root, run


def counts_hold(spark, root):
    read = lambda name: tables.read_table(spark, root, name)
    kept = read("area_count").where("listings <> 0")
    columns = ("section_type", "region", "province", "listings")
    assert rows(kept, *columns) == rows(refresh_counts(read("listing"), read("rental_unit"), read("building")), *columns)


def test_untouched_buckets_keep_their_files(spark, store):
    root, run = store
    keys = [f"K{i}" for i in range(40)]
    run(page_rows(spark, (URL.format("011", 1), "".join(card(k, 100) for k in keys))), 0)
    before = files(root, "listing")
    assert len({d for d, _ in before}) == 8 and tables.read_table(spark, root, "listing").count() == 40
    run(page_rows(spark, (URL.format("011", 1), card("K7", 90) + card("K8", 100))), 1)
    after = files(root, "listing")
    bucket = spark.createDataFrame([("K7",)], "source_id string").select(tables.bucket_of("listing", 8)).first()[0]
    assert {d.rsplit("=")[-1] for d, _ in before ^ after} == {str(bucket)}
    assert rows(tables.read_table(spark, root, "listing").where("price = 900000"), "source_id", "last_updated") == [("K7", T2)]
    assert rows(tables.read_log(spark, root, "price_history"), "price") == [(900_000,)]
    counts_hold(spark, root)


def test_repeated_and_broken_batches_give_the_same_tables(spark, store, monkeypatch):
    root, run = store
    first = page_rows(spark, (URL.format("011", 1), card("A", 100) + card("B", 100)), (URL.format("040", 1), RENTAL), (None, "x"))
    second = page_rows(spark, (URL.format("021", 1), card("A", 80) + card("C", 70)), (URL.format("040", 1), RENTAL))
    run(first, 0)

    def state():
        names = ("listing", "rental_unit", "building", "train_line", "station", "building_station", "area_count")
        logs = ("price_history", "rental_price_history", "page_metric", "batch_metric", "page_reject", "ingest_commit")
        some = lambda df: sorted(map(repr, df.select([c for c in df.columns if c != "additional_fields"]).collect()))
        return {n: some(tables.read_table(spark, root, n)) for n in names} | {n: some(tables.read_log(spark, root, n)) for n in logs}

    once = state()
    run(first, 0)
    assert state() == once and once["rental_unit"] and once["price_history"] == []
    counts_hold(spark, root)

    write, calls = ingest.write_buckets, []

    def failing(df, folder, name):
        calls.append(name)
        if len(calls) == stop:
            raise OSError("lost")
        write(df, folder, name)

    whole = None
    for stop in (2, 6):  # while the batch is staged, and while it is copied
        calls.clear()
        monkeypatch.setattr(ingest, "write_buckets", failing)
        with pytest.raises(OSError):
            run(second, 1)
        monkeypatch.setattr(ingest, "write_buckets", write)
        if stop == 2:
            assert {k: v for k, v in state().items() if k != "ingest_commit"} == {k: v for k, v in once.items() if k != "ingest_commit"}
    run(second, 1)
    whole = state()
    run(second, 1)
    assert state() == whole
    listing = tables.read_table(spark, root, "listing")
    assert rows(listing, "source_id", "price", "section_type") == [("A", 800_000, "021"), ("B", 1_000_000, "011"), ("C", 700_000, "021")]
    assert rows(tables.read_log(spark, root, "price_history"), "price") == [(800_000,)]
    assert listing.select("id").distinct().count() == 3 and len(os.listdir(f"{root}/_staged")) == 1
    counts_hold(spark, root)


def test_rentals_through_the_stream(spark, tmp_path):
    root = str(tmp_path)
    for number, html in enumerate((RENTAL, RENTAL.replace("6.1万円", "5.9万円"))):
        page_rows(spark, (URL.format("040", 1), html)).coalesce(1).write.mode("append").parquet(f"{root}/pages")
        at = AT(T2 if number else T1)
        stream_upsert(stream_pages(spark, f"{root}/pages"), f"{root}/tables", SITE, f"{root}/state", lambda n: at, 4).awaitTermination()
    read = lambda name: tables.read_table(spark, f"{root}/tables", name)
    assert rows(read("rental_unit"), "source_id", "rent", "building_id") == [("U1", 59_000, 1), ("U2", 0, 1)]
    assert read("building").count() == 1 and read("building_station").count() == 1
    assert rows(tables.read_log(spark, f"{root}/tables", "rental_price_history"), "rent") == [(0,), (59_000,), (61_000,)]
    assert rows(tables.read_log(spark, f"{root}/tables", "batch_metric"), "version", "items", "new_items", "updated_items") == [(1, 2, 2, 0), (2, 2, 0, 1)]
    counts_hold(spark, f"{root}/tables")
