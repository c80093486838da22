"""Pages with several cards, malformed cards and both pagers."""

from pyspark.sql import functions as F

from estatelake.functions import markup as m
from estatelake.operators import cards

SITE = "https://site.example"


def pages(spark, *html, **columns):
    rows = [(i, f"{SITE}/p/{i}/", h) for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def sale(id_input, body):
    return f'<div class="property_unit x">{id_input}<h2 class="property_unit-title"><a href="/d/1/">T</a></h2>{body}</div>'


BOX = '<div class="dottable"><div class="dottable-line"><dl><dt>専有面積</dt><dd>50.45m<sup>2</sup>（壁芯）</dd></dl><dl><dt>バルコニー</dt><dd>8m</dd></dl></div></div>'


def test_sale_cards_without_id_or_facts_are_left_out(spark):
    page = "<html><body>" + "".join(
        [sale('<input name="bsnc" value="A">', BOX), sale("", BOX), sale('<input name="bsnc" value="B">', ""), sale('<input name="bsnc" value="">', BOX),
         sale('<input name="bsnc" value="C">', BOX)]
    )
    rows = cards.normalise_listing(cards.type_sale_facts(cards.extract_sale_cards(pages(spark, page, "<p>none", ""), SITE)))
    got = {r["source_id"]: r for r in rows.collect()}
    assert set(got) == {"A", "C"}
    assert (got["A"]["building_area"], got["A"]["land_area"], got["A"]["layout"]) == (50.45, 0.0, None)
    assert got["A"]["additional_fields"] == {"バルコニー": "8m"} and got["A"]["url"] == f"{SITE}/d/1/"


RENTAL = (
    '<div class="cassetteitem"><img rel="https://i.example/f/g/h/b/339/100426191626/x.jpg"><div class="cassetteitem_content-title">A</div>'
    '<ul><li class="cassetteitem_detail-col1">北海道札幌市中央区</li><li class="cassetteitem_detail-col2">'
    '<div class="cassetteitem_detail-text">地下鉄南北線/幌平橋駅 歩24分</div><div class="cassetteitem_detail-text">none</div></li></ul><table>'
    '<tr class="js-cassette_link"><td><input class="js-single_checkbox" value="U1"><td>x<td>4階<td><span class="cassetteitem_price--rent">'
    '<span class="cassetteitem_other-emphasis">6.1万円</span></span><span class="cassetteitem_price--administration">4000円</span></tr>'
    '<tr class="js-cassette_link"><td>no id</td></tr><tr class="js-cassette_link"><td><input class="js-single_checkbox" value="U2"></td></tr></table></div>'
)


def test_rental_building_with_units(spark):
    units = cards.extract_rental_units(pages(spark, RENTAL + RENTAL.replace("rel=", "data-x=")), SITE).orderBy("building_ordinal", "source_id").collect()
    assert [(u["building_key"], u["source_id"]) for u in units] == [
        ("building-100426191626", "U1"), ("building-100426191626", "U2"), ("building-", "U1"), ("building-", "U2"),
    ]
    first = units[0]
    assert (first["rent"], first["management_fee"], first["floor"], first["city"]) == (61_000, 4_000, "4階", "札幌市")
    assert [tuple(s) for s in first["stations"]] == [("地下鉄南北線", "幌平橋駅", 24)]
    assert (units[1]["rent"], units[1]["floor"]) == (0, "")


def test_project_lead_phase(spark):
    phase = lambda price, size: (
        f'<li class="cassette_price-list_item"><div class="cassette_price-value">{price}</div><span class="cassette_price-accent">{price}</span>'
        f'<p class="cassette_price-description">1LDK / {size}m2～</p></li>'
    )
    card = lambda key, phases: f'<div class="cassette x"><input class="js-bsnckey" value="{key}"><ul>{phases}</ul></div>'
    page = card("P1", phase("7368万円～", 90) + phase("6400万円台～", 62.72) + phase("6988万円～", 70)) + card("P2", phase("未定", 5)) + card("", "") + card("P3", "")
    got = {r["source_id"]: r for r in cards.extract_project_cards(pages(spark, page, province="13"), SITE).collect()}
    assert set(got) == {"P1", "P2", "P3"}
    assert (got["P1"]["price"], got["P1"]["building_area"]) == (64_000_000, 62.72)
    assert got["P1"]["price_text"] == "7368万円～ / 6400万円台～ / 6988万円～"
    assert (got["P2"]["price"], got["P2"]["building_area"]) == (0, 5.0)
    assert (got["P3"]["price"], got["P3"]["price_text"]) == (0, "")


def test_selector_semantics(spark):
    page = '<div class="a-b"><div class="b"><span title="">x</span><span title="t">yes</span></div></div><p>un<p>closed<br>&nbsp;!'
    count = lambda q: cards.select_nodes(pages(spark, page), q).count()
    assert count('//div[class~="b"]') == 2
    assert count('//div[@class="b"]') == 1
    assert count('//div[class="zzz"]') == 2  # a condition of an unknown shape is ignored
    assert count("//span[@title]") == 1
    assert count("//div//span") == 4  # both nested divs reach both spans
    assert count('//span[text()="yes"]') == 1 and count('//span[contains(text(),"e")]') == 1
    assert count("/div") == 0 and count("//p") == 2
    texts = [r["text"] for r in cards.select_nodes(pages(spark, page), "//p").orderBy("ordinal").collect()]
    assert texts == ["un", "closed\xa0!"]


def test_node_sizes_cover_the_page(spark):
    rows = pages(spark, "<ul><li>a<li>b<b>c</b></ul><td>x").select(m.html_nodes("html").alias("n")).first()["n"]
    assert [(n["tag"], n["size"], n["parent"]) for n in rows] == [
        ("ul", 6, 0), ("li", 1, 1), ("#text", 0, 2), ("li", 3, 1), ("#text", 0, 4), ("b", 1, 4), ("#text", 0, 6), ("td", 1, 0), ("#text", 0, 8),
    ]


def test_class_profile(spark):
    got = cards.class_profile(pages(spark, '<p class="ad"><p class="ad big"><div class="bad">'), "ad").orderBy("tag").collect()
    assert [tuple(r) for r in got] == [("div", 1, 0, 1, 0), ("p", 2, 1, 1, 1)]


def test_details_resolve_to_the_outline(spark):
    th = lambda label, value: f'<tr><th class="overview_table-title">{label}</th> <td>{value}</td></tr>'
    main = "<table>" + th("価格", "1万円 [ □x ]") + '</table><img rel="https://i/?src=gazo%2F1.jpg"><a href="property/">o</a>'
    outline = '<table><tr><th class="detailtable-title">構造・階建て</th><td>RC15<br>階建</td></tr></table>'
    rows = [(1, f"{SITE}/m/1/", main), (2, f"{SITE}/m/1/property/", outline), (3, f"{SITE}/m/3/", main), (4, f"{SITE}/m/3/property/", "<p>")]
    facts, photos = cards.resolve_details(spark.createDataFrame(rows, "page_id long, url string, html string"), "https://i/?src=gazo")
    assert sorted(tuple(r) for r in facts.collect()) == [(1, 0, "構造・階建て", "RC15 階建"), (3, 0, "価格", "1万円")]
    assert sorted(r["page_id"] for r in photos.collect()) == [1, 3]


def test_only_named_references_of_a_title_are_read(spark):
    page = '<title>a&lt;b &amp;&quot; c&amp</title><script>if (a && b) {}</script><p title="x&amp;y&z">&copy</p>'
    titles = cards.select_nodes(pages(spark, page), "//title", references=("lt", "gt", "amp")).collect()
    assert [r["text"] for r in titles] == ["a<b &&quot; c&amp"]
    script, p = (cards.select_nodes(pages(spark, page), f"//{tag}", references=("lt", "gt", "amp")).first() for tag in ("script", "p"))
    assert script["text"] == "if (a && b) {}" and p["text"] == "&copy" and p["attrs"]["title"] == "x&y&z"


PLAIN = (
    '<!DOCTYPE html><title>a &amp; b</title><!-- c --><div class="a b">x<BR/><p>1<p ID="2">2<ul><li>i<li class="k">j</ul></div>'
    '<a href="?a=1&amp;b" href="2">t</a><span/>&nbsp;<script>var a = "&amp;";</script></b>'
)


def test_plain_markup_is_walked_as_the_parser_walks_it():
    assert m._plainly_walked(PLAIN) == m.parsed(PLAIN)
    for odd in ('<a title="x>y">', "<a b='c'>", "a < b", "<script>if(a<b)</script>", "<title>a<b></title>", "<p", "<!-->", "<textarea>a"):
        assert m._plainly_walked(odd) is None and m.walked(odd) == m.parsed(odd)


def test_a_batch_of_pages_is_held_a_few_at_a_time(spark, monkeypatch):
    from estatelake.functions import layouts

    held, most = [], []

    class Counted(list):
        def to_pylist(self):
            return list(self)

    monkeypatch.setattr(layouts, "walked", lambda page: held.append(page) or m.walked(page))
    kept = layouts.pa.array
    monkeypatch.setattr(layouts.pa, "array", lambda *a, **k: most.append(len(held)) or held.clear() or kept(*a, **k))
    caught = {}
    monkeypatch.setattr(layouts.F, "arrow_udf", lambda f, kind: caught.setdefault("f", f) and (lambda c: c))
    layouts.html_extract("html", "pager")
    out = caught["f"](kept([PLAIN, None] * 150))
    assert len(out) == 300 and out.null_count == 150 and max(most) <= 64


def test_detail_joins_bring_no_side_to_the_driver(spark):
    made = pages(spark, "<table><tr><th class='thSideLGray'>A</th><td>1</td></tr></table>")
    facts, photos = cards.resolve_details(made, "g/")
    for rows in (facts, photos):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_pages_of_one_frame_differ_in_what_they_say():
    page = lambda n, title="t": f'<title>{title}</title><ul><li id="{n}">a{n} &amp; b<li>c{n}</ul><script>x&amp;{n}</script>'
    m._FRAMES.clear()
    for html in (page(1), page(2), page(3, ""), page(4)):
        assert m.walked(html) == m.parsed(html)
    assert len(m._FRAMES) == 2
    assert m._plainly_walked(page(5)).places["li"] == [i for i, n in enumerate(m.parsed(page(5))) if n["tag"] == "li"]
    long = "".join(page(n) for n in range(200))
    assert m.walked(long) == m.parsed(long) and len(m._FRAMES) == 2
