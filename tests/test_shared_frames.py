"""Pages written alike share the entries of their frame, and layouts read the same records from these."""

from estatelake.functions import layouts
from estatelake.functions import markup as m

CARD = (
    '<html><body><div class="property_unit x"><input name="bsnc" value="{0}"><input class="js-clipkey" value="k{0}">'
    '<ul class="property_unit-pcts"><li><span class="ui-pct">t{0} &amp; u<li><span class="ui-pct">{1}</span></ul>'
    '<h2 class="property_unit-title"><a href="/s/{0}">{1} title</a></h2><div class="dottable"><div class="dottable-line">'
    '<dl><dt>販売価格<dd><span class="dottable-value">{0}万円</span></dl><dl><dt>{1}</dt><dd>name {0}</dd></dl></div></div></div></body></html>'
)


def records(nodes, read):
    part = layouts.Part(nodes, 0, len(nodes), getattr(nodes, "places", None), getattr(nodes, "found", None))
    return list(read(part))


def test_pages_of_a_frame_share_its_entries_and_give_their_own_records():
    pages = [CARD.format(n, word) for n, word in ((1, "a"), (2, layouts.LABEL_NAME), (3, ""), (4, "b"), (5, ""))]
    for read in (layouts.sale_cards, layouts.details, layouts.pager, layouts.rental_cards):
        assert [records(m.walked_shared(p), read) for p in pages] == [records(m.parsed(p), read) for p in pages]
    one, two = m.walked_shared(pages[0]), m.walked_shared(pages[3])
    assert one.said != two.said and all(a is b for a, b in zip(one, two, strict=True))
    # What takes entries as they are gets whole ones.
    assert m.walked(pages[3]) == m.parsed(pages[3]) and m.walked(pages[2]) == m.parsed(pages[2])
