"""Stored tables: one explicit schema per table, never inferred."""

from __future__ import annotations

_STOPS = "array<struct<line:string,station:string,walking_minutes:int>>"

TABLES = {
    "page": "page_id long, url string, kind string, html string",
    "page_reject": "page_id long, url string, kind string, html string",
    "ingest_commit": "query_id string, batch_id long, version long",
    "ingest_layout": "buckets int",
    "row_reject": "table string, row string",
    "stored_id": "table string, id long",
    "area_count": "section_type string, region string, province string, listings long",
    "page_metric": (
        "section_key string, page int, items long, new_items long, updated_items long, unchanged_items long"
    ),
    "batch_metric": "version long, items long, new_items long, updated_items long, unchanged_items long",
    "listing": (
        "id long, source_id string, js_id string, region string, province string, section_type string, "
        "property_type string, price long, price_text string, area double, land_area double, land_area_text string, "
        "building_area double, layout string, building_coverage int, floor_area_ratio int, price_per_tsubo double, "
        "train_line string, train_station string, walking_minutes int, address string, postal_code string, "
        "state string, city string, district string, title string, property_name string, url string, "
        "main_image_url string, image_urls array<string>, tags array<string>, photo_types array<string>, "
        "additional_fields map<string,string>, insert_date date, last_updated timestamp, detail_fetched_at timestamp"
    ),
    "price_history": "property_id long, price long, price_text string, recorded_at timestamp",
    "building": (
        "id long, source_id string, url string, building_type string, title string, address string, age string, "
        f"floors string, main_image_url string, stations {_STOPS}, region string, province string, "
        "postal_code string, state string, city string, district string, insert_date timestamp, last_updated timestamp"
    ),
    "rental_unit": (
        "id long, source_id string, js_id string, building_id long, url string, floor string, rent long, "
        "rent_text string, management_fee long, management_fee_text string, deposit string, gratuity string, "
        "layout string, size double, size_text string, thumbnail_url string, image_urls array<string>, "
        "tags array<string>, insert_date timestamp, last_updated timestamp"
    ),
    "rental_price_history": (
        "rental_unit_id long, rent long, rent_text string, management_fee long, management_fee_text string, "
        "recorded_at timestamp"
    ),
    "train_line": (
        "id long, name string, translated_name string, operator string, region string, kind string, "
        "canonical_id string, canonical_name string"
    ),
    "station": "id long, name string, translated_name string, train_line_id long",
    "building_station": "id long, building_id long, station_id long, walking_minutes int, last_updated timestamp",
    "canonical_line": (
        "ord long, code string, ekidata_id string, name_kanji string, name_kana string, name_romaji string, "
        "alternative_names array<string>, prefectures array<string>"
    ),
    "detail_fact": "property_id long, sort_order int, label string, value string",
    "detail_photo": "property_id long, sort_order int, url string, caption string",
    "detail_request": "property_id long, status string, requested_at timestamp, attempts int, last_error string",
    "translation_cache": "source_text string, translated_text string",
    "ingest_run": (
        "id long, status string, start_time timestamp, end_time timestamp, region string, province string, "
        "type string, total_items int, processed_items int, total_pages int, error string"
    ),
    "ingest_section": (
        "id long, run_id long, section_key string, region string, province string, section_type string, "
        "calc_total_items int, scraped_pages int, computed_pages int, total_pages int, pages_fetched int, "
        "items_processed int, new_items int, updated_items int, stop_reason string, started_at timestamp, "
        "finished_at timestamp, error string"
    ),
    "line_proposal": (
        "id long, name string, region string, old_kind string, new_kind string, old_canonical_id string, "
        "new_canonical_id string, new_canonical_name string, old_translated_name string, clear_bus_name boolean, "
        "changed boolean"
    ),
    "building_merge_plan": "building_key string, keep_id long, source_id long, unit_count long",
}

# Partitioning of the big tables: a search names its type and region, so these prune whole directories.
PARTITIONS = {
    "listing": ["section_type", "region"],
    "building": ["region"],
}

# Order inside the files of a table, so that a search's range and sort columns skip row groups.
CLUSTERING = {
    "listing": ["province", "price"],
    "building": ["province", "last_updated"],
    "rental_unit": ["building_id", "rent"],
}

# Tables that micro-batches write lie in hash buckets of these columns, and a batch writes the buckets it meets. Area counts are a
# few hundred rows and one bucket.
BUCKET_KEYS = {
    "listing": "source_id",
    "rental_unit": "source_id",
    "building": "id",
    "train_line": "id",
    "station": "id",
    "building_station": "building_id",
    "area_count": None,
}
