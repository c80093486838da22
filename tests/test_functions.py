"""Column functions on single values."""

import math

import pytest
from pyspark.sql import functions as F

from estatelake.functions import labels, measures, money, places, records, replies, text, transit, urls


def values(spark, function, inputs):
    """The function's result for every input text, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").coalesce(1)
    found = rows.select("i", function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


def test_parse_price(spark):
    cases = {
        "1億2000万円": 120_000_000, "3500万円": 35_000_000, "3500万円～4000万円": 35_000_000, "3500万円・4000万円": 35_000_000,
        "2億3456万7円": 234_567_000, "": 0, "価格": 0, "2億円": 200_000_000, "12億円": 200_000_000, "2,480万円": 4_800_000,
        "1000万～2000万円": 0,
    }
    assert values(spark, money.parse_price, list(cases)) == list(cases.values())
    strict = {"12億円": 1_200_000_000, "2,480万円": 24_800_000, "1000万～2000万円": 10_000_000}
    assert values(spark, lambda c: money.parse_price(c, strict=True), list(strict)) == list(strict.values())


def test_parse_area_and_size(spark):
    areas = values(spark, measures.parse_area, ["75.5㎡", "120.25m", "", None, "75.5 square meters", "面積"])
    assert areas[:5] == [75.5, 120.25, 0.0, 0.0, 75.5] and math.isnan(areas[5])
    assert values(spark, measures.parse_size, ["40.16m²", "", "40.16m2"]) == [40.16, 0.0, 40.162]
    assert values(spark, lambda c: measures.parse_size(c, strict=True), ["40.16m2"]) == [40.16]


def test_parse_rent(spark):
    assert values(spark, money.parse_rent, ["6.1万円", "4000円", "-", "", "8.35万円"]) == [61_000, 4_000, 0, 0, 83_500]


def test_every_two_decimal_rent_is_whole(spark):
    texts = [f"{n // 100}.{n % 100:02d}万円" for n in range(1, 9_999)]
    assert values(spark, money.parse_rent, texts) == [n * 100 for n in range(1, 9_999)]


@pytest.mark.parametrize(
    "label, expected",
    [
        ("JR山手線「渋谷」徒歩8分", ("JR山手線", "渋谷", 8)), ("北海道中央バス「朝日町西3丁目」歩6分", ("北海道中央バス", "朝日町西3丁目", 6)),
        ("徒歩10分", ("", "", 10)), ("JR山手線「渋谷」", ("JR山手線", "渋谷", 0)), ("", ("", "", 0)),
    ],
)
def test_parse_station(spark, label, expected):
    assert tuple(values(spark, transit.parse_station, [label])[0]) == expected


def test_parse_station_info(spark):
    got = values(spark, transit.parse_station_info, ["地下鉄南北線/幌平橋駅 歩24分", ""])
    assert [tuple(g) for g in got] == [("地下鉄南北線", "幌平橋駅", 24), ("", "", 0)]


def test_parse_access(spark):
    got = values(spark, transit.parse_access, ["東急東横線/祐天寺 徒歩3分", "a/b 徒歩5分～6分", "none"])
    assert [tuple(g) for g in got] == [("東急東横線", "祐天寺", 3), ("a", "b", 5), ("", "", 0)]


def test_parse_address(spark):
    cases = {
        "北海道滝川市朝日町西３": ("北海道", "滝川市", "朝日町西３"), "北海道茅部郡鹿部町字本別": ("北海道", "茅部郡鹿部町", "字本別"),
        "北海道虻田郡洞爺湖町三豊163-124": ("北海道", "虻田郡洞爺湖町", "三豊163-124"), "": ("", "", ""), "123 Main St": ("", "", ""),
        "東京都千代田区四番町市場": ("東京都", "千代田区四番町市", "場"),
    }
    assert [tuple(v) for v in values(spark, places.parse_address, list(cases))] == list(cases.values())


def test_prefectures(spark):
    assert values(spark, places.prefecture_code, ["北海道", "東京都", "神奈川県", "沖縄県", "東京", "Tokyo", ""]) == [
        "01", "13", "14", "47", None, None, None,
    ]
    assert values(spark, places.region_of, ["13", "27", "47", "99"]) == ["030", "060", "090", None]
    completed = values(spark, lambda c: places.complete_address(c, F.lit("13")), ["目黒区祐天寺１", "大阪府北区", ""])
    assert completed == ["東京都目黒区祐天寺１", "大阪府北区", ""]


def test_names_and_buses(spark):
    names = {
        "ＪＲ中央線": "JR中央線", "地下鉄南北線/幌平橋駅 歩24分": "地下鉄南北線", "目黒駅行": "目黒", "〔南ルート〕": "",
        "臨海２８-１〔東小松川車庫〕": "臨海28-1",
    }
    assert values(spark, lambda c: transit.bare_name(text.nfkc(c)), list(names)) == list(names.values())
    buses = ["小72", "亀26", "渋11", "013", "黒06", "西武バス　高松五丁目停", "周遊バス〔南ルート〕", "目黒駅行", "小７２・新小７１[小岩駅-本郷"]
    rails = ["東急東横線", "ＪＲ中央線", "東京メトロ銀座線", "湘南新宿ライン", "つくばエクスプレス", ""]
    assert values(spark, lambda c: transit.looks_like_bus(text.nfkc(c)), buses + rails) == [True] * 9 + [False] * 6


def test_dice(spark):
    assert values(spark, transit.bigrams, ["abab", "a", ""]) == [["ab", "ba"], ["a"], []]
    assert values(spark, lambda c: transit.dice(c, F.lit("abc")), ["abc", "abd", "", "xyz"]) == [1.0, 0.5, 0.0, 0.0]


def test_labels(spark):
    number = lambda f: lambda c: f(c.cast("long"))
    assert values(spark, number(money.short_yen), ["1100000", "800000", "999499"]) == ["¥1.1M", "¥800K", "¥999K"]
    assert values(spark, number(money.yen), ["16370000"]) == ["¥16,370,000"]
    assert values(spark, number(money.man), ["16370000"]) == ["1,637万円"]
    assert values(spark, lambda c: measures.sqm(c.cast("double")), ["27.7", "27", "1234.56"]) == ["27.7 m²", "27 m²", "1,234.6 m²"]
    counts = ["49", "50", "150", "400", "1000", "2500"]
    assert values(spark, number(labels.count_bucket), counts) == [0, 1, 2, 3, 4, 5]
    assert values(spark, lambda c: labels.photo_count(F.lit("a.jpg"), c), ["b.jpg, c.jpg", None, "b.jpg,"]) == [3, 1, 2]
    ages = ["2026-01-31 01:00:00", "2026-01-30 00:00:00", "2026-01-26 00:00:00", "2026-01-20 00:00:00", "2026-01-05 00:00:00", "2025-12-20 00:00:00", "2025-10-01 00:00:00"]
    age = lambda c: labels.age_label(F.to_timestamp(c), F.to_timestamp(F.lit("2026-01-31 02:00:00")))
    assert values(spark, age, ages) == ["today", "1 day ago", "5 days ago", "1 week ago", "3 weeks ago", "1 month ago", "4 months ago"]


def test_rent_choice(spark):
    rows = spark.createDataFrame([(None, None), (50_000, 75_000), (None, 50_000), (300_000, None), (1, 2)], "low long, high long")
    got = [r[0] for r in rows.select(money.rent_choice(F.col("low"), F.col("high"))).collect()]
    assert got == ["any", "1", "0", "6", "custom"]


def test_replies(spark):
    got = values(
        spark, replies.parse_choice,
        ['```json\n{"kind":"rail","canonical_id":"1"}\n``` ok', '{"kind":"bus","canonical_id":"1"}', "no idea", '{"kind":"rail","canonical_id":"null"}'],
    )
    assert [tuple(g) for g in got] == [("rail", "1"), ("bus", None), ("unknown", None), ("rail", None)]
    rows = spark.createDataFrame([("1. Shibuya\n2) unknown\nnote\n10. Ebisu ",)], "reply string")
    assert [(r["item"], r["answer"]) for r in replies.numbered_replies(rows, "reply", True).collect()] == [(1, "Shibuya"), (10, "Ebisu")]


def test_urls_and_records(spark):
    host = lambda c: urls.allowed_url(c, "site.example")
    assert values(spark, host, ["https://site.example/a", "https://x.site.example/", "http://site.example/", "https://badsite.example/", "no url"]) == [
        True, True, False, False, False,
    ]
    assert values(spark, urls.outline_url, ["https://s.example/a/b/", "https://s.example/a/b?x=1"]) == [
        "https://s.example/a/b/property/", "https://s.example/a/b/property/",
    ]
    assert values(spark, urls.photo_key, ["https://i/?src=gazo%2F1.jpg&w=1", "https://i/1.jpg"]) == ["gazo/1.jpg", None]
    assert [len(v) for v in values(spark, records.stations_from_json, ['[{"line":"a"}]', "[", None, '{"line":"a"}'])] == [1, 0, 0, 0]


def test_a_line_of_a_reply_is_read_once_for_each_value(spark):
    rows = spark.createDataFrame([(7, "Here:\n1. a\r\n12) b c \n٣. d\n.5. e\n99999999999. f\n2.\n3. g")], "id int, reply string")
    found = replies.numbered_replies(rows, "reply", True)
    assert [(r["item"], r["answer"]) for r in found.collect()] == [(1, "a"), (12, "b c"), (3, "g")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
