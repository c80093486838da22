"""Pages to rows: sale cards, rental buildings and units, new-apartment cards, detail pages and pager totals.

Each function takes pages with an ``html`` column and keeps the other page columns. Cards are exploded once; all typing
afterwards is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import (
    BUILDING_KEY_PREFIX, DETAIL_LABEL_CLASSES, LABEL_ACCESS, LABEL_ADDRESS, LABEL_BUILDING_AREA, LABEL_COVERAGE,
    LABEL_LAND_AREA, LABEL_LAYOUT, LABEL_NAME, LABEL_PHOTOS, LABEL_PRICE, LABEL_STATION, LABEL_TSUBO, LABEL_UNIT_AREA,
    MOVIE_ICON, TYPED_LABELS,
)
from estatelake.functions import markup as m
from estatelake.functions.layouts import html_extract
from estatelake.functions.measures import known, parse_area, parse_size
from estatelake.functions.money import (
    building_coverage, floor_area_ratio, parse_price, parse_rent, price_per_tsubo,
)
from estatelake.functions.places import complete_address, parse_address
from estatelake.functions.text import collapse_ws, filled, nfkc, strip_brackets, trim_all
from estatelake.functions.transit import parse_access, parse_station, parse_station_info
from estatelake.functions.urls import absolute_url, outline_url, photo_key
from estatelake.session import settled

_STRINGS = "array<string>"


def page_nodes(pages: DataFrame) -> DataFrame:
    """The pages with their markup as an element array ``nodes`` instead of ``html``."""
    return pages.withColumn("nodes", m.html_nodes("html")).drop("html")


def _non_empty(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def _last_wins(entries: Column) -> Column:
    """Map of (key, value) entries; where a key repeats, the later entry counts."""

    def fold(all_: Column) -> Column:
        later = lambda i: F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0)))
        return F.filter(all_, lambda e, i: ~F.exists(later(i), lambda o: o["key"] == e["key"]))

    return F.map_from_entries(m.let(entries, fold))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


# --- sale cards ------------------------------------------------------------------------------------------------------


def _card_facts(card: Column) -> Column:
    """The label/value map of a card's fact box."""
    lines = F.zip_with(card["labels"], card["values"], lambda k, v: _pair(trim_all(k), trim_all(v)))
    photo_types = F.array_join(_non_empty(F.transform(card["photo_types"], trim_all)), ", ")
    extra = F.array(_pair(F.lit(LABEL_NAME), trim_all(card["name"])), _pair(F.lit(LABEL_PHOTOS), photo_types))
    return _last_wins(F.filter(F.concat(lines, extra), lambda e: (e["key"] != "") & (e["value"] != "")))


def extract_sale_cards(pages: DataFrame, origin: str) -> DataFrame:
    """One row per for-sale card with its raw texts and its label/value map ``facts``. Cards without an id or a fact
    box are left out."""
    keep = [x for x in pages.columns if x not in ("html", "url")]
    found = pages.select(*keep, F.explode(html_extract("html", "sale")).alias("c"))
    c = F.col("c")
    return found.select(
        *keep,
        c["ordinal"].alias("ordinal"),
        c["source_id"].alias("source_id"),
        F.coalesce(filled(c["clip_key"]), c["source_id"]).alias("js_id"),
        _non_empty(F.transform(c["tags"], trim_all)).alias("tags"),
        trim_all(c["title"]).alias("title"),
        absolute_url(c["href"], origin).alias("url"),
        c["main_image_url"].alias("main_image_url"),
        F.filter(c["thumbs"], lambda u: (u != "") & ~F.contains(u, F.lit(MOVIE_ICON))).alias("image_urls"),
        _card_facts(c).alias("facts"),
    )


def type_sale_facts(cards: DataFrame) -> DataFrame:
    """Known labels to typed columns, all other labels to ``additional_fields``."""
    fact = lambda label: F.try_element_at(F.col("facts"), F.lit(label))
    stop = parse_station(fact(LABEL_STATION))
    address = F.coalesce(fact(LABEL_ADDRESS), F.lit(""))
    place = parse_address(address)
    land = parse_area(fact(LABEL_LAND_AREA))
    # A card states one of the two; a unit's floor area stands in for the building's.
    building = parse_area(F.coalesce(fact(LABEL_UNIT_AREA), fact(LABEL_BUILDING_AREA)))
    return cards.select(
        *[x for x in cards.columns if x != "facts"],
        parse_price(fact(LABEL_PRICE)).alias("price"),
        fact(LABEL_PRICE).alias("price_text"),
        land.alias("area"),
        land.alias("land_area"),
        fact(LABEL_LAND_AREA).alias("land_area_text"),
        building.alias("building_area"),
        fact(LABEL_LAYOUT).alias("layout"),
        building_coverage(fact(LABEL_COVERAGE)).alias("building_coverage"),
        floor_area_ratio(fact(LABEL_COVERAGE)).alias("floor_area_ratio"),
        price_per_tsubo(fact(LABEL_TSUBO)).alias("price_per_tsubo"),
        stop["line"].alias("train_line"),
        stop["station"].alias("train_station"),
        stop["walking_minutes"].alias("walking_minutes"),
        address.alias("address"),
        F.lit("").alias("postal_code"),
        place["province"].alias("state"),
        place["city"].alias("city"),
        place["district"].alias("district"),
        F.coalesce(fact(LABEL_NAME), F.lit("")).alias("property_name"),
        F.coalesce(F.split(fact(LABEL_PHOTOS), ", "), F.array().cast(_STRINGS)).alias("photo_types"),
        F.map_filter("facts", lambda k, _: ~k.isin(TYPED_LABELS)).alias("additional_fields"),
    )


_NUMBERS = {
    "price": "long", "area": "double", "land_area": "double", "building_area": "double", "building_coverage": "int",
    "floor_area_ratio": "int", "price_per_tsubo": "double", "walking_minutes": "int",
}
_TEXTS = [
    "title", "main_image_url", "property_name", "price_text", "land_area_text", "address", "train_line",
    "train_station", "postal_code", "state", "city", "district",
]


def normalise_listing(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Stored form of a listing: unknown numbers are 0, unknown texts empty, a missing layout null."""
    columns = {c: known(F.col(c), kind) for c, kind in _NUMBERS.items() if c in df.columns}
    columns.update({c: F.coalesce(c, F.lit("")) for c in _TEXTS if c in df.columns})
    columns["layout"] = filled(F.col("layout"))
    if as_of:
        columns["insert_date"] = F.to_date(F.lit(as_of))
    return df.withColumns(columns)


# --- rentals ---------------------------------------------------------------------------------------------------------


def extract_rental_buildings(pages: DataFrame, origin: str) -> DataFrame:
    """One row per rental building with its stations and its units as an array of structs. A building's key is the
    ninth path part of its first image; one without an image gets the bare prefix."""
    keep = [x for x in pages.columns if x not in ("html", "url")]
    found = pages.select(*keep, F.explode(html_extract("html", "rental")).alias("c"))
    c = F.col("c")
    stations = F.filter(
        F.transform(c["stops"], lambda s: parse_station_info(trim_all(s))), lambda s: (s["line"] != "") & (s["station"] != "")
    )
    image_key = F.coalesce(F.get(F.split(c["image"], "/"), F.lit(8)), F.lit(""))
    return found.select(
        *keep,
        c["ordinal"].alias("ordinal"),
        F.concat(F.lit(BUILDING_KEY_PREFIX), image_key).alias("building_key"),
        trim_all(c["type"]).alias("building_type"),
        trim_all(c["title"]).alias("building_title"),
        trim_all(c["address"]).alias("building_address"),
        c["image_src"].alias("building_image_url"),
        trim_all(c["age"]).alias("building_age"),
        trim_all(c["floors"]).alias("building_floors"),
        stations.alias("stations"),
        F.transform(F.filter(c["units"], lambda u: u["source_id"] != ""), lambda u: _unit(u, origin)).alias("units"),
    )


def _unit(unit: Column, origin: str) -> Column:
    raw = ("source_id", "js_id", "thumbnail_url")
    texts = {
        name: (unit[name] if name in raw else trim_all(unit[name])).alias(name)
        for name in (
            "source_id", "js_id", "floor", "rent_text", "management_fee_text", "deposit", "gratuity", "layout", "size_text", "thumbnail_url",
        )
    }
    href = unit["href"]
    return F.struct(
        texts.pop("source_id"), texts.pop("js_id"), F.when(href != "", F.concat(F.lit(origin), href)).otherwise("").alias("url"),
        *texts.values(),
        F.filter(F.split(unit["images"], ","), lambda u: F.trim(u) != "").alias("image_urls"),
        _non_empty(F.transform(unit["tags"], trim_all)).alias("tags"),
    )


def rental_units(buildings: DataFrame) -> DataFrame:
    """One row per unit with its building's columns, typed amounts and the parts of the address."""
    keep = [x for x in buildings.columns if x not in ("units", "ordinal")]
    place = parse_address(F.col("building_address"))
    rows = buildings.select(
        *keep, F.col("ordinal").alias("building_ordinal"), F.posexplode("units").alias("unit_ordinal", "u")
    )
    return rows.select(
        *[x for x in rows.columns if x != "u"],
        "u.*",
        parse_rent(F.col("u.rent_text")).alias("rent"),
        parse_rent(F.col("u.management_fee_text")).alias("management_fee"),
        known(parse_size(F.col("u.size_text"))).alias("size"),
        place["province"].alias("state"),
        place["city"].alias("city"),
        place["district"].alias("district"),
        F.lit("").alias("postal_code"),
    )


def extract_rental_units(pages: DataFrame, origin: str) -> DataFrame:
    return rental_units(extract_rental_buildings(pages, origin))


# --- new-apartment cards ---------------------------------------------------------------------------------------------


def _phases(card: Column) -> Column:
    """Price phases of a project: text, price, layouts and smallest area of each."""

    def described(accent: Column, value: Column, text: Column) -> Column:
        # Layouts and sizes are parted by the last " / " of the description.
        parted = F.contains(text, F.lit(" / "))
        sizes = trim_all(F.substring_index(text, " / ", -1))
        return F.struct(
            F.coalesce(filled(value), accent).alias("text"),
            parse_price(accent).alias("price"),
            F.when(parted, trim_all(F.regexp_replace(text, r"^(.*) / .*$", "$1"))).otherwise(text).alias("layout"),
            F.when(parted, known(parse_area(sizes))).otherwise(F.lit(0.0)).alias("area"),
        )

    tidy = F.transform(
        F.arrays_zip(card["accents"].alias("accent"), card["prices"].alias("value"), card["descriptions"].alias("text")),
        lambda t: F.struct(*[collapse_ws(t[f]).alias(f) for f in ("accent", "value", "text")]),
    )
    return F.transform(tidy, lambda t: described(t["accent"], t["value"], t["text"]))


def price_phases(cards: DataFrame) -> DataFrame:
    """One row per price phase of each project, in page order."""
    return cards.select("source_id", F.posexplode("phases").alias("phase", "p")).select("source_id", "phase", "p.*")


def lead_phase(phases: Column) -> Column:
    """The cheapest phase that has a price (the earlier one on a tie), or the first phase where none has."""
    priced = F.filter(phases, lambda p: p["price"] > 0)
    lowest = F.array_min(F.transform(priced, lambda p: p["price"]))
    cheapest = m.let(lowest, lambda low: F.get(F.filter(priced, lambda p: p["price"] == low), F.lit(0)))
    return F.coalesce(cheapest, F.get(phases, F.lit(0)))


def extract_project_cards(pages: DataFrame, origin: str, province: Column | None = None) -> DataFrame:
    """One row per new-apartment card, priced at its lead phase. ``province`` is the searched prefecture's code; the
    pages' own ``province`` column is used where it is not given."""
    c = F.col("c")
    searched = province if province is not None else F.col("province")
    basics = F.filter(
        F.zip_with(c["labels"], c["values"], lambda k, v: _pair(collapse_ws(k), collapse_ws(v))),
        lambda e: (e["key"] != "") & (e["value"] != ""),
    )
    keep = [x for x in pages.columns if x not in ("html", "url")]
    raw = pages.select(*pages.columns, F.explode(html_extract("html", "project")).alias("c")).select(
        *keep,
        c["ordinal"].alias("ordinal"),
        c["source_id"].alias("source_id"),
        F.coalesce(filled(c["clip_key"]), c["source_id"]).alias("js_id"),
        _non_empty(F.transform(c["tags"], collapse_ws)).alias("tags"),
        collapse_ws(c["title"]).alias("title"),
        absolute_url(c["href"], origin).alias("url"),
        _non_empty(c["photos"]).alias("photos"),
        _last_wins(basics).alias("basics"),
        _phases(c).alias("phases"),
        searched.alias("_searched"),
    )
    fact = lambda label: F.coalesce(F.try_element_at(F.col("basics"), F.lit(label)), F.lit(""))
    typed = raw.withColumns(
        {
            "address": complete_address(fact(LABEL_ADDRESS), F.col("_searched")),
            "_stop": parse_access(fact(LABEL_ACCESS)),
            "_lead": lead_phase(F.col("phases")),
        }
    )
    lead, stop = F.col("_lead"), F.col("_stop")
    place = parse_address(F.col("address"))
    return typed.select(
        *[x for x in raw.columns if x not in ("photos", "basics", "_searched")],
        F.coalesce(F.get("photos", F.lit(0)), F.lit("")).alias("main_image_url"),
        F.slice("photos", F.lit(2), F.greatest(F.size("photos"), F.lit(1))).alias("image_urls"),
        F.col("title").alias("property_name"),
        F.coalesce(lead["price"], F.lit(0)).cast("long").alias("price"),
        F.array_join(F.transform("phases", lambda p: p["text"]), " / ").alias("price_text"),
        F.lit(0.0).alias("area"),
        F.lit(0.0).alias("land_area"),
        F.coalesce(lead["area"], F.lit(0.0)).alias("building_area"),
        filled(lead["layout"]).alias("layout"),
        "address",
        stop["line"].alias("train_line"),
        stop["station"].alias("train_station"),
        stop["walking_minutes"].alias("walking_minutes"),
        F.lit("").alias("postal_code"),
        place["province"].alias("state"),
        place["city"].alias("city"),
        place["district"].alias("district"),
        F.map_filter("basics", lambda k, _: ~k.isin(LABEL_ADDRESS, LABEL_ACCESS)).alias("additional_fields"),
    )


# --- detail pages ----------------------------------------------------------------------------------------------------


def _detail_facts(detail: Column) -> Column:
    """Array of (label, value) in document order, repeated labels included."""
    read = F.zip_with(
        detail["labels"], detail["values"],
        lambda k, v: F.struct(collapse_ws(k).alias("label"), strip_brackets(collapse_ws(v)).alias("value")),
    )
    return F.filter(read, lambda f: (f["label"] != "") & (f["value"] != "") & (f["value"] != "-"))


def _detail_photos(detail: Column, photo_prefix: str) -> Column:
    """Array of (url, caption) in document order, repeated files included."""
    images = F.zip_with(detail["photos"], detail["captions"], lambda u, t: F.struct(u.alias("url"), t.alias("caption")))
    mine = F.filter(images, lambda i: F.startswith(i["url"], F.lit(photo_prefix)))
    return F.transform(mine, lambda i: F.struct(i["url"].alias("url"), collapse_ws(i["caption"]).alias("caption")))


def _outline_link(detail: Column) -> Column:
    """Address of the page's own outline sub-page where the page links to it, else null."""
    wanted = outline_url(F.col("url"))
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    base = F.regexp_replace("url", r"[?#].*$", "")

    def target(href: Column) -> Column:
        path = F.regexp_replace(href, r"[?#].*$", "")
        relative = F.concat(F.regexp_replace(base, r"[^/]*$", ""), path)
        return (
            F.when(path.rlike("^https?://"), path)
            .when(F.startswith(path, F.lit("//")), F.concat(F.regexp_extract("url", "^(https?:)", 1), path))
            .when(F.startswith(path, F.lit("/")), F.concat(origin, path))
            .otherwise(relative)
        )

    hrefs = _non_empty(detail["hrefs"])
    linked = m.let(wanted, lambda address: F.exists(hrefs, lambda h: target(h) == address))
    return F.when(linked, wanted)


def read_details(pages: DataFrame, photo_prefix: str) -> DataFrame:
    """Everything a detail page says, in one walk: (page_id, url, outline_url, facts, photos)."""
    d = F.col("d")
    return pages.select("page_id", "url", F.get(html_extract("html", "detail"), F.lit(0)).alias("d")).select(
        "page_id", "url", _outline_link(d).alias("outline_url"), _detail_facts(d).alias("facts"),
        _detail_photos(d, photo_prefix).alias("photos"),
    )


def detail_facts(details: DataFrame) -> DataFrame:
    """(page_id, sort_order, label, value). The first row of a label counts; labels that differ only by width are the
    same label."""
    rows = details.select("page_id", F.posexplode("facts").alias("_at", "_row"))
    return _first_rows(rows.withColumn("_key", nfkc(F.col("_row.label"))))


def detail_photos(details: DataFrame) -> DataFrame:
    """(page_id, sort_order, url, caption), unique by source file."""
    rows = details.select("page_id", F.posexplode("photos").alias("_at", "_row"))
    return _first_rows(rows.withColumn("_key", photo_key(F.col("_row.url"))).where(F.col("_key").isNotNull()))


def extract_detail_facts(pages: DataFrame) -> DataFrame:
    return detail_facts(read_details(pages, ""))


def extract_detail_photos(pages: DataFrame, photo_prefix: str) -> DataFrame:
    return detail_photos(read_details(pages, photo_prefix))


def _first_rows(rows: DataFrame) -> DataFrame:
    """First row per page and key in document order, renumbered from 0. Grouping by key folds repeats before the
    shuffle; what is left per page is the page's own list."""
    firsts = rows.groupBy("page_id", "_key").agg(F.min("_at").alias("_at"), F.min_by("_row", "_at").alias("_row"))
    listed = firsts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_rows"))
    return listed.select("page_id", F.posexplode("_rows").alias("sort_order", "_r")).select(
        "page_id", "sort_order", "_r._row.*"
    )


def resolve_details(pages: DataFrame, photo_prefix: str) -> tuple[DataFrame, DataFrame]:
    """Facts and photos of every page that is not itself an outline. A page with an outline takes the outline's facts
    where that has any; the photos are always the page's own.

    Every side of the joins grows with the pages, while Spark estimates sides read back from a checkpoint by the pages' own input, which
    may be far smaller; so no side may be broadcast, which would bring it to the driver."""
    details = settled(read_details(pages, photo_prefix))
    ids = details.select(
        F.col("page_id").alias("outline_id"), F.col("url").alias("outline_url"), (F.size("facts") > 0).alias("_filled")
    )
    pairs = details.where(F.col("outline_url").isNotNull()).select("page_id", "outline_url").hint("merge").join(ids, "outline_url")
    outlines = pairs.select(F.col("outline_id").alias("page_id")).distinct()
    borrowed = pairs.where("_filled").select("page_id", F.col("outline_id").alias("_from"))
    shown = details.join(outlines.hint("merge"), "page_id", "left_anti")
    own = shown.join(borrowed.select("page_id").hint("merge"), "page_id", "left_anti").select("page_id", "facts")
    lent = details.select(F.col("page_id").alias("_from"), "facts").join(borrowed.hint("merge"), "_from").select("page_id", "facts")
    return detail_facts(own.unionByName(lent)), detail_photos(shown)


# --- pager, selectors and class usage --------------------------------------------------------------------------------


def page_totals(pages: DataFrame) -> DataFrame:
    """Item total and last page number of every list page, in either pager layout."""
    p = F.col("_pager")
    leading = lambda text: F.regexp_extract(F.regexp_replace(text, ",", ""), "^([0-9]+)", 1).try_cast("int")
    number = lambda text: F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("int")
    numbers = F.transform(p["pages"], lambda text: number(trim_all(text)))
    last = F.coalesce(F.try_element_at(F.filter(numbers, lambda n: n > 0), F.lit(-1)), number(trim_all(p["current"])), F.lit(1))
    total = F.coalesce(leading(trim_all(p["hit"])), leading(collapse_ws(p["box"])), F.lit(0))
    keep = [x for x in pages.columns if x != "html"]
    return pages.select(*keep, F.get(html_extract("html", "pager"), F.lit(0)).alias("_pager")).select(
        *keep, total.alias("total_items"), last.alias("scraped_pages")
    )


def select_nodes(pages: DataFrame, query: str, references: tuple[str, ...] = ()) -> DataFrame:
    """One row per element a selector finds: (page_id, ordinal, tag, attrs, text). Where ``references`` are named, only these are read,
    and only with their semicolon; all others stay as they are written."""
    nodes = F.col("nodes")
    if references:
        pages = pages.withColumn("html", m.only_references(F.col("html"), references))
    found = F.transform(
        m.select(nodes, query),
        lambda n: F.struct(n["tag"].alias("tag"), n["attrs"].alias("attrs"), m.text_of(nodes, n).alias("text")),
    )
    return (
        page_nodes(pages.select("page_id", "html"))
        .select("page_id", F.posexplode(found).alias("ordinal", "n"))
        .select("page_id", "ordinal", "n.*")
    )


def class_profile(pages: DataFrame, name: str) -> DataFrame:
    """How a class name is used over all pages, per tag: elements, exact and partial matches, multi-class elements."""
    found = F.transform(
        F.filter("nodes", m.class_contains(name)),
        lambda n: F.struct(n["tag"].alias("tag"), m.attr(n, "class").alias("classes")),
    )
    exact = F.col("classes") == name
    return (
        page_nodes(pages.select("html"))
        .select(F.explode(found).alias("n"))
        .select("n.*")
        .groupBy("tag")
        .agg(
            F.count("*").alias("elements"),
            F.count_if(exact).alias("exact_matches"),
            F.count_if(~exact).alias("partial_matches"),
            F.count_if(F.size(F.filter(F.split("classes", r"\s+"), lambda c: c != "")) > 1).alias("multi_class"),
        )
    )
