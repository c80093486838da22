"""Column functions and translation jobs. Texts are built from the tables' own figures, so SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelake.fixed_values import PREFECTURES_JA
from estatelake.functions import labels, measures, money, places, records, replies, text, transit, urls
from estatelake.operators import counts, filters, metrics, translations
from estatelake.registry import query
from estatelake.registry.tables import Tables, with_views
from estatelake.sources.dims import listing_types, prefectures

_S = lambda c: F.col(c).cast("string")


# --- prices, rents, areas --------------------------------------------------------------------------------------------


@query("""SELECT id, CASE kind WHEN 'F' THEN n * 10000 WHEN 'O' THEN (n // 10000 % 10) * 100000000 + (n % 10000) * 10000
    ELSE n * 10000 END AS price, CASE kind WHEN 'F' THEN n * 10000 WHEN 'O' THEN (n // 10000) * 100000000 + (n % 10000) * 10000
    ELSE n * 10000 END AS strict_price FROM (SELECT o_orderkey AS id, o_orderstatus AS kind,
    CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def parse_prices(t: Tables):
    """F: ``n万円``, O: ``a億b万円``, P: a range that starts at n."""
    n = F.floor("o_totalprice")
    price_text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(n, F.lit("万円")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.floor(n / 10_000), F.lit("億"), n % 10_000, F.lit("万円")))
        .otherwise(F.concat(n, F.lit("万円～"), n + 500, F.lit("万円")))
    )
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), price_text.alias("text"))
    return rows.select(
        "id", money.parse_price(F.col("text")).alias("price"), money.parse_price(F.col("text"), strict=True).alias("strict_price")
    )


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN p ELSE (p // 100) * 100 END AS rent,
    CASE WHEN l_linestatus = 'O' THEN 0 ELSE p % 1000 END AS fee FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)""")
def parse_rents(t: Tables):
    p = F.floor("l_extendedprice")
    man = F.concat(F.floor(p / 10_000), F.lit("."), F.lpad(F.floor(p % 10_000 / 100).cast("string"), 2, "0"), F.lit("万円"))
    rent_text = F.when(F.col("l_returnflag") == "R", F.concat(p, F.lit("円"))).otherwise(man)
    fee_text = F.when(F.col("l_linestatus") == "O", "-").otherwise(F.concat(p % 1000, F.lit("円")))
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"),
        money.parse_rent(rent_text).alias("rent"), money.parse_rent(fee_text).alias("fee"),
    )


@query("""SELECT p_partkey AS id, CAST(n AS DOUBLE) + 0.5 AS area, CASE WHEN p_size > 25 THEN CAST(n || '.52' AS DOUBLE)
    ELSE CAST(n || '.5' AS DOUBLE) END AS size, CAST(n || '.5' AS DOUBLE) AS strict_size,
    n * 10000.0::DOUBLE AS per_tsubo, p_size AS coverage, CAST(p_size * 4 AS INTEGER) AS ratio
    FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS n FROM part)""")
def parse_measures(t: Tables):
    n = F.floor("p_retailprice")
    area = F.concat(n, F.when(F.col("p_size") > 25, ".5㎡（実測）").otherwise(".5m"))
    size = F.concat(n, F.when(F.col("p_size") > 25, ".5m2").otherwise(".5m"))
    tsubo = F.concat(F.format_number(n, 0), F.lit("万円"))
    cover = F.concat(F.lit("建ぺい率："), "p_size", F.lit("％、容積率："), F.col("p_size") * 4, F.lit("％"))
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), measures.parse_area(area).alias("area"), measures.parse_size(size).alias("size"),
        measures.parse_size(size, strict=True).alias("strict_size"), money.price_per_tsubo(tsubo).alias("per_tsubo"),
        money.building_coverage(cover).alias("coverage"), money.floor_area_ratio(cover).alias("ratio"),
    )


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN low = 0 AND high = 0 THEN 'any' WHEN low = 0 AND high = 50000 THEN '0'
    WHEN low = 50000 AND high = 75000 THEN '1' WHEN low = 75000 AND high = 100000 THEN '2' WHEN low = 100000 AND high = 150000 THEN '3'
    ELSE 'custom' END AS choice FROM (SELECT *, CAST(l_quantity AS BIGINT) // 10 * 25000 AS low,
    CAST(l_quantity AS BIGINT) // 10 * 25000 + CASE l_returnflag WHEN 'R' THEN 25000 WHEN 'A' THEN 50000 ELSE 0 END AS high FROM lineitem)""")
def rent_choices(t: Tables):
    low = F.floor(F.col("l_quantity").cast("long") / 10) * 25_000
    high = low + F.when(F.col("l_returnflag") == "R", 25_000).when(F.col("l_returnflag") == "A", 50_000).otherwise(0)
    none = lambda c: F.when(c > 0, c)
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), money.rent_choice(none(low), none(high)).alias("choice")
    )


# --- addresses and stations ------------------------------------------------------------------------------------------

_PREFS = "[" + ", ".join(f"'{p}'" for p in PREFECTURES_JA) + "]"


@query(f"""SELECT c_custkey AS id, CASE WHEN bare THEN '' ELSE pref END AS province, CASE WHEN bare THEN ''
    WHEN c_mktsegment = 'BUILDING' THEN '茅部郡' || c_nationkey || '町' WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey || '区中市' ELSE c_nationkey || '区' END AS city,
    CASE WHEN bare THEN '' ELSE c_custkey || '丁目' END AS district, CASE WHEN bare THEN NULL ELSE lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') END AS code,
    CASE WHEN bare THEN pref ELSE '' END || CASE WHEN bare THEN '' ELSE pref END || seg || c_custkey || '丁目' AS completed
    FROM (SELECT *, c_mktsegment = 'FURNITURE' AS bare, {_PREFS}[c_nationkey + 1] AS pref, CASE c_mktsegment WHEN 'BUILDING'
    THEN '茅部郡' || c_nationkey || '町' WHEN 'MACHINERY' THEN c_nationkey || '区中市' ELSE c_nationkey || '区' END AS seg FROM customer)""")
def parse_addresses(t: Tables):
    """Customers at an address of the prefecture numbered like their nation; furniture makers leave the prefecture out.
    A 市 anywhere in the text ends the city before an earlier 区 does."""
    nation = F.col("c_nationkey")
    pref = F.get(F.array(*[F.lit(p) for p in PREFECTURES_JA]), nation)
    place = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("茅部郡"), nation, F.lit("町")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(nation, F.lit("区中市")))
        .otherwise(F.concat(nation, F.lit("区")))
    )
    prefix = F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(pref)
    rows = t.raw("customer").select(
        F.col("c_custkey").alias("id"), F.concat(prefix, place, "c_custkey", F.lit("丁目")).alias("address"),
        F.lpad((nation + 1).cast("string"), 2, "0").alias("searched"),
    )
    parts = places.parse_address(F.col("address"))
    return rows.select(
        "id", parts["province"].alias("province"), parts["city"].alias("city"), parts["district"].alias("district"),
        places.prefecture_code(parts["province"]).alias("code"),
        places.complete_address(F.col("address"), F.col("searched")).alias("completed"),
    )


@query("""SELECT l_orderkey AS id, l_linenumber AS n, 'JR' || l_suppkey || '線' AS line, 's' || l_partkey AS station,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS walking_minutes, 'JR' || l_suppkey || '線' AS info_line,
    's' || l_partkey || '駅' AS info_station, CAST(l_quantity AS INTEGER) AS info_minutes, CAST(l_quantity AS INTEGER) AS access_minutes FROM lineitem""")
def parse_stops(t: Tables):
    line, station = F.concat(F.lit("JR"), "l_suppkey", F.lit("線")), F.concat(F.lit("s"), "l_partkey")
    minutes = F.col("l_quantity").cast("int")
    a = F.concat(line, F.lit("「"), station, F.lit("」"), F.when(F.col("l_returnflag") == "R", "バス").otherwise(F.concat(F.lit("徒歩"), minutes, F.lit("分"))))
    b = F.concat(line, F.lit("/"), station, F.lit("駅 歩"), minutes, F.lit("分"))
    c = F.concat(line, F.lit("/"), station, F.lit(" 徒歩"), minutes, F.lit("分～"), minutes + 3, F.lit("分"))
    one, two, three = transit.parse_station(a), transit.parse_station_info(b), transit.parse_access(c)
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), one["line"].alias("line"),
        one["station"].alias("station"), one["walking_minutes"].alias("walking_minutes"), two["line"].alias("info_line"),
        two["station"].alias("info_station"), two["walking_minutes"].alias("info_minutes"),
        three["walking_minutes"].alias("access_minutes"),
    )


@query("""SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'JR' || n || '線' WHEN 'PROMO' THEN n WHEN 'SMALL' THEN n || p_size
    WHEN 'LARGE' THEN n WHEN 'MEDIUM' THEN '小' || p_size ELSE n || 'ライナー線' END AS norm,
    CASE p_type WHEN 'ECONOMY' THEN FALSE WHEN 'PROMO' THEN TRUE WHEN 'SMALL' THEN TRUE WHEN 'LARGE' THEN TRUE WHEN 'MEDIUM' THEN TRUE
    ELSE FALSE END AS bus FROM (SELECT *, replace(p_name, ' ', '') AS n FROM part)""")
def normalised_names(t: Tables):
    """Line labels in the shapes crawled pages show, one shape per part type."""
    label = {
        "ECONOMY": F.concat(F.lit("ＪＲ"), "p_name", F.lit("線/駅前 歩3分")), "PROMO": F.concat("p_name", F.lit("駅行")),
        "SMALL": F.concat("p_name", _S("p_size"), F.lit("〔東車庫〕")), "LARGE": F.concat("p_name", F.lit("停留所バス")),
        "MEDIUM": F.concat(F.lit("小"), F.translate(_S("p_size"), "0123456789", "０１２３４５６７８９")),
    }
    shape = F.concat("p_name", F.lit("ライナー線"))
    for kind, value in label.items():
        shape = F.when(F.col("p_type") == kind, value).otherwise(shape)
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), text.nfkc(shape).alias("folded"))
    return rows.select("id", transit.bare_name(F.col("folded")).alias("norm"), transit.looks_like_bus(F.col("folded")).alias("bus"))


# --- labels, urls, records -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Order ' || o_orderkey END AS title,
    coalesce(own, concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'm' || o_orderkey || '.jpg' END,
    CASE WHEN o_orderstatus <> 'F' THEN 'a.jpg,b.jpg' END)) AS photos FROM orders LEFT JOIN (SELECT l_orderkey,
    string_agg('d' || l_linenumber || '.jpg', ',' ORDER BY l_linenumber) AS own FROM lineitem WHERE l_returnflag = 'R'
    GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def listing_galleries(t: Tables):
    """Orders as listings with a name and their photos; returned lines are photos of the detail page."""
    returned = t.raw("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list("l_linenumber")).alias("numbers")
    )
    status = F.col("o_orderstatus")
    main = F.when(status == "O", F.concat(F.lit("m"), _S("o_orderkey"), F.lit(".jpg"))).otherwise("")
    extras = F.when(status != "F", F.array(F.lit("a.jpg"), F.lit(" "), F.lit(None).cast("string"), F.lit("b.jpg")))
    detail = F.transform("numbers", lambda n: F.concat(F.lit("d"), n.cast("string"), F.lit(".jpg")))
    name = F.when(status == "F", "").otherwise(F.concat(F.lit("Order "), _S("o_orderkey")))
    return t.raw("orders").join(returned, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), labels.building_name(name, F.col("o_orderpriority")).alias("title"),
        F.array_join(labels.gallery(main, extras, detail), ",").alias("photos"),
    )


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN '{"status":"' || o_orderpriority || '","key":"' || o_orderkey
    || '"}' ELSE '{}' END AS log FROM orders""")
def run_log_texts(t: Tables):
    """Run logs as JSON; finished runs have an empty log, partial ones none."""
    log = F.create_map(F.lit("status"), F.col("o_orderpriority"), F.lit("key"), _S("o_orderkey"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kept = F.when(F.col("o_orderstatus") == "O", log).when(F.col("o_orderstatus") == "F", none)
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), records.map_to_json(kept).alias("log"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 30 THEN p_type WHEN p_size > 10 THEN p_name ELSE p_brand END AS shown,
    CASE WHEN p_size > 30 THEN 3 WHEN p_size > 10 THEN 2 ELSE 0 END AS photos,
    concat_ws(', ', CASE WHEN p_size > 30 THEN p_type END, CASE WHEN p_size > 10 THEN p_name END, p_brand) AS address_line FROM part""")
def display_names(t: Tables):
    blank = lambda c, least: F.when(F.col("p_size") > least, F.col(c)).otherwise("")
    main = blank("p_name", 10)
    extra = F.when(F.col("p_size") > 30, "a.jpg, b.jpg,").when(F.col("p_size") > 10, "a.jpg, ").otherwise(" ,")
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), labels.listing_name(blank("p_type", 30), main, F.col("p_brand")).alias("shown"),
        labels.photo_count(main, extra).alias("photos"),
        places.address_line(blank("p_type", 30), main, F.col("p_brand")).alias("address_line"),
    )


@query("""SELECT page_id, CASE WHEN contains(url, 'bs=040') OR contains(url, '/jj/chintai/ichiran/') THEN 'rental' ELSE 'sale' END AS kind,
    split_part(url, '?', 1) AS bare, regexp_matches(url, '^https://([^/?#]*\\.)?example\\.com([/?#]|$)') AS allowed,
    regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/?$', '/') || 'property/' AS outline FROM pages""")
def page_urls(t: Tables):
    url = F.col("url")
    return t.raw("pages").select(
        "page_id", urls.classify_page(url).alias("kind"), urls.without_query(url).alias("bare"),
        urls.allowed_url(url, "example.com").alias("allowed"), urls.outline_url(url).alias("outline"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'https://img.example/jj/resizeImage?src=gazo%2Fp' || p_partkey ||
    '.jpg&w=1024&h=768' ELSE 'https://img.example/p/' || p_partkey || '.jpg?w=' || p_size END AS pinned,
    CASE WHEN p_size > 25 THEN 'gazo/p' || p_partkey || '.jpg' END AS photo_key,
    CASE WHEN p_size > 25 THEN 'https://img.example/jj/resizeImage?src=gazo%2Fp' || p_partkey || '.jpg&w=' || p_size
    ELSE 'https://img.example/p/' || p_partkey || '.jpg?w=' || p_size END AS absolute FROM part""")
def photo_urls(t: Tables):
    path = F.when(
        F.col("p_size") > 25, F.concat(F.lit("/jj/resizeImage?src=gazo%2Fp"), "p_partkey", F.lit(".jpg&w="), "p_size")
    ).otherwise(F.concat(F.lit("https://img.example/p/"), "p_partkey", F.lit(".jpg?w="), "p_size"))
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), urls.absolute_url(path, "https://img.example").alias("absolute"))
    return rows.withColumns({"pinned": urls.pinned_photo_url(F.col("absolute")), "photo_key": urls.photo_key(F.col("absolute"))})


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS stops,
    CASE WHEN l_returnflag <> 'R' THEN 'L' || l_suppkey END AS line, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS minutes FROM lineitem""")
def stored_stations(t: Tables):
    """Stations as stored JSON; returned items hold a malformed text or no array."""
    good = F.concat(F.lit('[{"line":"L'), "l_suppkey", F.lit('","station":"s","walking_minutes":'), "l_linenumber", F.lit("}]"))
    bad = F.when(F.col("l_linestatus") == "O", "[{").otherwise('{"line":"x"}')
    rows = t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"),
        records.stations_from_json(F.when(F.col("l_returnflag") == "R", bad).otherwise(good)).alias("s"),
    )
    return rows.select("id", "n", F.size("s").alias("stops"), F.get("s.line", F.lit(0)).alias("line"), F.get("s.walking_minutes", F.lit(0)).alias("minutes"))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'unknown' END AS status,
    event_type AS message, CAST(json_extract(props, '$.k') AS INTEGER) AS items_processed, 0 AS items_total,
    CASE WHEN event_type = 'error' THEN props END AS error FROM events""")
def run_statuses(t: Tables):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise(F.col("event_type"))
    fields = F.create_map(
        F.lit("status"), state, F.lit("message"), F.col("event_type"),
        F.lit("itemsProcessed"), F.get_json_object("props", "$.k"), F.lit("itemsTotal"), F.lit(""),
        F.lit("error"), F.when(F.col("event_type") == "error", F.col("props")).otherwise(""),
    )
    rows = t.raw("events").select(F.col("event_id").alias("id"), fields.alias("fields"))
    return records.normalise_status(rows, "fields").select("id", "status", "message", "items_processed", "items_total", "error")


@query("""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Rental' WHEN '2-HIGH' THEN 'Land' ELSE o_orderpriority END AS type_label,
    CASE WHEN c_nationkey < 1 THEN 'Hokkaido' WHEN c_nationkey < 7 THEN 'Tohoku' ELSE CAST(c_nationkey AS VARCHAR) END AS region_label,
    ['Hokkaido', 'Aomori', 'Iwate', 'Miyagi', 'Akita', 'Yamagata', 'Fukushima', 'Ibaraki', 'Tochigi', 'Gunma', 'Saitama', 'Chiba',
    'Tokyo', 'Kanagawa', 'Niigata', 'Toyama', 'Ishikawa', 'Fukui', 'Yamanashi', 'Nagano', 'Gifu', 'Shizuoka', 'Aichi', 'Mie', 'Shiga'][c_nationkey + 1]
    AS province_label FROM orders JOIN customer ON o_custkey = c_custkey""")
def scope_labels(t: Tables):
    nation = F.col("c_nationkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "040").when(F.col("o_orderpriority") == "2-HIGH", "030").otherwise(F.col("o_orderpriority"))
    region = F.when(nation < 1, "010").when(nation < 7, "020").otherwise(nation.cast("string"))
    runs = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), kind.alias("type"), region.alias("region"),
        F.lpad((nation + 1).cast("string"), 2, "0").alias("province"),
    )
    labelled = metrics.scope_labels(runs, listing_types(t.spark), prefectures(t.spark))
    return labelled.select("id", "type_label", "region_label", "province_label")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') ELSE 'none' END AS province,
    CASE WHEN o_orderstatus <> 'P' THEN 'none' WHEN c_nationkey < 1 THEN '010' WHEN c_nationkey < 7 THEN '020' WHEN c_nationkey < 14 THEN '030'
    WHEN c_nationkey < 20 THEN '040' WHEN c_nationkey < 24 THEN '050' ELSE '060' END AS region FROM orders JOIN customer ON o_custkey = c_custkey""")
def located_listings(t: Tables):
    """Listings of partly shipped orders name their prefecture; the others keep the section's own place."""
    pref = F.get(F.array(*[F.lit(p) for p in PREFECTURES_JA]), F.col("c_nationkey"))
    rows = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", pref).otherwise("").alias("state"),
        F.lit("none").alias("region"), F.lit("none").alias("province"),
    )
    return counts.backfill_location(rows).drop("state")


@query("""SELECT count(*) AS scanned, count(*) FILTER (o_orderstatus = 'P' AND c_nationkey <> 12) AS changed,
    count(*) FILTER (o_orderstatus <> 'P') AS unresolved FROM orders JOIN customer ON o_custkey = c_custkey""")
def location_totals(t: Tables):
    pref = F.get(F.array(*[F.lit(p) for p in PREFECTURES_JA]), F.col("c_nationkey"))
    rows = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.when(F.col("o_orderstatus") == "P", pref).otherwise("").alias("state"),
        F.lit("030").alias("region"), F.lit("13").alias("province"),
    )
    return counts.location_totals(rows)


@query("""SELECT l_orderkey AS id, l_partkey, l_linenumber AS item, l_returnflag || l_suppkey AS answer FROM lineitem WHERE l_returnflag <> 'N'""")
def numbered_replies(t: Tables):
    """Each line item as a reply with one numbered answer and a remark; answers of N items are unknown."""
    answer = F.when(F.col("l_returnflag") == "N", "Unknown").otherwise(F.concat("l_returnflag", "l_suppkey"))
    reply = F.concat(F.lit("Here you are:\n"), "l_linenumber", F.lit(".  "), answer, F.lit(" \n(end)"))
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", reply.alias("reply"))
    return replies.numbered_replies(rows, "reply", drop_unknown=True)


# --- translation -----------------------------------------------------------------------------------------------------


def _cache(t: Tables):
    """Texts of labelled documents with a stand-in translation."""
    return t.raw("documents").join(t.raw("labels").select("doc_id"), "doc_id", "left_semi").groupBy(
        F.col("text").alias("source_text")
    ).agg(F.min(F.concat_ws(":", "lang", "source")).alias("translated_text"))


_CACHE = """SELECT text AS source_text, min(lang || ':' || source) AS translated_text FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY text"""


@query(with_views("", """SELECT DISTINCT md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE trim(text) <> ''
    AND text NOT IN (SELECT source_text FROM cache)""", cache=_CACHE))
def missing_texts(t: Tables):
    texts = translations.distinct_texts(t.raw("documents"), ["text"])
    missing = translations.missing_translations(texts, _cache(t))
    return missing.select(F.md5("source_text").alias("digest"), F.length("source_text").alias("chars"))


@query(with_views("", """SELECT doc_id, md5(coalesce(translated_text, text)) AS digest FROM documents LEFT JOIN cache
    ON source_text = text""", cache=_CACHE))
def decorated_texts(t: Tables):
    rows = translations.decorate(t.raw("documents").select("doc_id", "text"), ["text"], _cache(t))
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query(with_views("", """SELECT md5(source_text) AS digest, translated_text FROM cache UNION ALL SELECT md5(text), min('new ' || lang)
    FROM documents WHERE text NOT IN (SELECT source_text FROM cache) GROUP BY text""", cache=_CACHE))
def appended_translations(t: Tables):
    fresh = t.raw("documents").select(F.col("text").alias("source_text"), F.concat(F.lit("new "), "lang").alias("translated_text"))
    return translations.append_translations(_cache(t), fresh).select(F.md5("source_text").alias("digest"), "translated_text")


@query("SELECT DISTINCT p_name AS source_text, upper(p_name) AS translated_text FROM part")
def translated_names(t: Tables):
    """A caller's own translator over the distinct texts that need one."""
    texts = translations.distinct_texts(t.raw("part"), ["p_name"])
    return translations.translate(texts, lambda batch: batch.str.upper())


def _named(t: Tables):
    when = lambda least, c: F.when(F.col("p_size") > least, F.upper(c))
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("property_name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("title"),
        when(20, "p_name").alias("translated_property_name"), when(35, "p_type").alias("translated_title"),
    )


_WORK = """SELECT p_partkey AS id, 'property_name' AS field, p_name AS text FROM part WHERE p_size <= 20 UNION ALL
    SELECT p_partkey, 'title', p_type FROM part WHERE p_size <= 35 AND p_size % 2 = 0"""


@query(with_views("", "SELECT * FROM work", work=_WORK))
def translation_worklist(t: Tables):
    return translations.translation_worklist(_named(t))


@query(with_views("", """SELECT id, field, (row_number() OVER (ORDER BY id, field) - 1) // 50 AS batch FROM work""", work=_WORK))
def request_batches(t: Tables):
    work = translations.translation_worklist(_named(t))
    return translations.assign_batches(work, order=["field"], width=500).select("id", "field", "batch")


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN upper(p_name) ELSE 'T ' || p_name END AS translated_property_name,
    CASE WHEN p_size <= 35 AND p_size % 2 = 0 THEN 'T ' || p_type WHEN p_size > 35 THEN upper(p_type) END AS translated_title FROM part""")
def applied_translations(t: Tables):
    work = translations.translation_worklist(_named(t))
    done = work.withColumn("text", F.concat(F.lit("T "), "text"))
    return translations.apply_translations(_named(t), done).select("id", "translated_property_name", "translated_title")


@query("""SELECT 'line' AS type, n_name AS name FROM nation WHERE n_regionkey = 4 AND n_nationkey IN (SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'station', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey >= 3 OR s_acctbal <= 0""")
def names_to_translate(t: Tables):
    """Suppliers as stations of their nation's line. Lines of the first three regions are stored; of the new ones those of
    region 3 get a canonical name and need no translation."""
    nation = t.raw("nation")
    stops = t.raw("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("line"), F.col("s_name").alias("station")
    )
    line = nation.where(F.col("n_regionkey") < 3).select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    station = t.raw("supplier").where(F.col("s_acctbal") > 0).select(F.col("s_nationkey").alias("train_line_id"), F.col("s_name").alias("name"))
    decisions = nation.select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 3, F.col("n_name")).alias("canonical_name")
    )
    return translations.names_to_translate(translations.new_names(stops, line, station), decisions)


@query("""SELECT p_partkey AS id FROM part WHERE p_size <= 20 OR (p_size <= 35 AND p_size % 2 = 0)""")
def needs_translation(t: Tables):
    return filters.needs_translation(_named(t)).select("id")
