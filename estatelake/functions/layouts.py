"""Raw texts of a layout's cards, taken from the markup in one walk per page.

A layout is a function from a page's elements to one record per card. It only says which element's text or attribute a field
takes; trimming, typing and every rule about values are column expressions on the short arrays it yields, so what leaves the
worker are the few texts a card states and not the page's elements.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from estatelake.fixed_values import DETAIL_LABEL_CLASSES, LABEL_NAME
from estatelake.functions.markup import walked_shared as walked

_BLANKS = re.compile(r"\s", re.A)
_MAP_CLASS = re.compile(r"(?:^|\s)\S*_map(?:\s|$)", re.A)


class Part:
    """An element with everything in it: the entries ``start`` to ``end`` of a page. ``places`` has the page's entries by tag, ``found``
    where looked-up elements and texts lie: both hang on tags and classes only, so pages of one frame share them."""

    __slots__ = ("nodes", "start", "end", "places", "found")

    def __init__(
        self, nodes: list[dict], start: int, end: int, places: dict[str, list[int]] | None = None, found: dict | None = None
    ) -> None:
        self.nodes, self.start, self.end = nodes, start, end
        if places is None:
            places = {}
            for at, node in enumerate(nodes):
                places.setdefault(node["tag"], []).append(at)
        self.places, self.found = places, {} if found is None else found

    def _at(self, at: int) -> Part:
        return Part(self.nodes, at, at + self.nodes[at]["size"] + 1, self.places, self.found)

    def _places(self, tag: str | None) -> list[int] | range:
        if tag is None:
            return range(self.start, self.end)
        held = self.places.get(tag)
        return held[bisect_left(held, self.start) : bisect_left(held, self.end)] if held else []

    def _holding(self, tag: str | None, part: str) -> list[int]:
        """Places of the elements with a text within their class."""
        key = (self.start, self.end, tag, part)
        held = self.found.get(key)
        if held is None:
            held = self.found[key] = [at for at in self._places(tag) if part in self.nodes[at]["class"]]
        return held

    def each(self, tag: str | None = None, part: str = "", name: str = "class") -> Iterator[Part]:
        """Elements at and in this one, in order: of a tag, with a text within an attribute."""
        if name == "class":
            yield from map(self._at, self._holding(tag, part))
            return
        for at in self._places(tag):
            if not part or part in attribute(self.nodes, at, name):
                yield self._at(at)

    def word(self, tag: str | None, word: str) -> Iterator[Part]:
        """Those with a whole class name."""
        for at in self._holding(tag, word):
            if word in _BLANKS.split(self.nodes[at]["class"]):
                yield self._at(at)

    def first(self, tag: str, part: str = "", name: str = "class") -> Part | None:
        if name == "class":
            key = (self.start, self.end, tag, part, 1)
            if key in self.found:
                at = self.found[key]
                return None if at is None else self._at(at)
        held = self.places.get(tag, ())
        for i in range(bisect_left(held, self.start), len(held)):
            at = held[i]
            if at >= self.end:
                break
            if not part or part in (self.nodes[at]["class"] if name == "class" else attribute(self.nodes, at, name)):
                if name == "class":
                    self.found[key] = at
                return self._at(at)
        if name == "class":
            self.found[key] = None
        return None

    def first_word(self, tag: str | None, word: str) -> Part | None:
        return next(self.word(tag, word), None)

    def holder(self, inner: Part) -> Part | None:
        """The element around an inner one; None where it lies outside this one."""
        at = self.nodes[inner.start]["parent"] - 1
        return self._at(at) if at >= self.start else None

    def following(self) -> Part | None:
        """The next sibling element, past any texts."""
        parent = self.nodes[self.start]["parent"] - 1
        end = parent + self.nodes[parent]["size"] + 1 if parent >= 0 else len(self.nodes)
        for at in range(self.end, end):
            # Texts have no entries inside, so every entry met is a sibling.
            if self.nodes[at]["tag"] != "#text":
                return self._at(at)
        return None

    def text(self) -> str:
        key = (self.start, self.end)
        held = self.found.get(key)
        if held is None:
            held = self.found[key] = [at for at in range(self.start, self.end) if self.nodes[at]["tag"] == "#text"]
        return "".join([said(self.nodes, at) for at in held])

    def attr(self, name: str) -> str:
        return attribute(self.nodes, self.start, name)


def said(nodes: list[dict], at: int) -> str:
    """What a text entry says."""
    texts = getattr(nodes, "said", None)
    return nodes[at]["text"] if texts is None else texts[nodes[at]["attrs"]]


def attribute(nodes: list[dict], at: int, name: str) -> str:
    attrs, texts = nodes[at]["attrs"], getattr(nodes, "said", None)
    if texts is not None:
        attrs = () if nodes[at]["tag"] == "#text" else nodes.read[attrs][0]
    for key, value in attrs:
        if key == name:
            return value
    return ""


def text(part: Part | None) -> str:
    return part.text() if part else ""


def attr(part: Part | None, name: str) -> str:
    return part.attr(name) if part else ""


SALE = (
    StructType()
    .add("ordinal", IntegerType())
    .add("source_id", StringType())
    .add("clip_key", StringType())
    .add("tags", ArrayType(StringType()))
    .add("title", StringType())
    .add("href", StringType())
    .add("main_image_url", StringType())
    .add("thumbs", ArrayType(StringType()))
    .add("labels", ArrayType(StringType()))
    .add("values", ArrayType(StringType()))
    .add("name", StringType())
    .add("photo_types", ArrayType(StringType()))
)


def _fact_lines(box: Part) -> Iterator[tuple[str, str]]:
    """Labels and values of a fact box: for each line those of its labels, then those of its table cells."""
    for line in box.each("div", "dottable-line"):
        for label in line.each("dt"):
            holder = box.holder(label)
            value = holder.first("dd") if holder else None
            yield label.text(), text(value and (value.first("span", "dottable-value") or value))
        for row in line.each("tr"):
            for cell in row.each("td"):
                yield text(cell.first("dt")), text(cell.first("dd"))


def sale_cards(page: Part) -> Iterator[dict]:
    """For-sale cards with an id and a fact box. ``ordinal`` counts all cards of the page."""
    for ordinal, card in enumerate(page.each(part="property_unit ")):
        source_id, box = attr(card.first("input", "bsnc", "name"), "value"), card.first("div", "dottable")
        if not source_id or box is None:
            continue
        facts = list(_fact_lines(box))
        named = next((d for d in box.each("dt") if d.text() == LABEL_NAME), None)
        around = named and box.holder(named)
        photos, media = box.first("ul", "property_unit-info-pct"), (m.first("img") for m in card.each("div", "ui-media-object"))
        yield {
            "ordinal": ordinal,
            "source_id": source_id,
            "clip_key": attr(card.first("input", "js-clipkey"), "value"),
            "tags": [s.text() for u in card.each("ul", "property_unit-pcts") for li in u.each("li") for s in li.each("span", "ui-pct")],
            "title": text(card.first("h2", "property_unit-title")),
            "href": attr(card.first("a"), "href"),
            "main_image_url": attr(next(filter(None, media), None), "rel"),
            "thumbs": [i.attr("rel") for u in card.each("ul", "property_unit-thumb") for i in u.each("img")],
            "labels": [label for label, _ in facts],
            "values": [value for _, value in facts],
            "name": text(around.first("dd") if around else None),
            "photo_types": [text(li.first("span")) for li in photos.each("li")] if photos else [],
        }


_TEXTS = ArrayType(StringType())


def _record(texts: str, lists: str = "") -> StructType:
    fields = StructType()
    for name in texts.split():
        fields = fields.add(name, IntegerType() if name == "ordinal" else StringType())
    for name in lists.split():
        fields = fields.add(name, _TEXTS)
    return fields


RENTAL_UNIT = _record(
    "source_id js_id href floor rent_text management_fee_text deposit gratuity layout size_text thumbnail_url images", "tags"
)
RENTAL = _record("ordinal image type title address image_src age floors", "stops").add("units", ArrayType(RENTAL_UNIT))


def _within(part: Part, outer: tuple[str, str], inner: tuple[str, str]) -> Iterator[Part]:
    """Elements of the second kind in each element of the first."""
    for box in part.each(*outer):
        yield from box.each(*inner)


def _rental_unit(row: Part) -> dict:
    price = lambda kind: text(row.first("span", f"cassetteitem_price--{kind}"))
    cells = [c for c in row.each("td") if row.nodes[c.start]["parent"] == row.start + 1]
    rent = _within(row, ("span", "cassetteitem_price--rent"), ("span", "cassetteitem_other-emphasis"))
    return {
        "source_id": attr(row.first("input", "js-single_checkbox"), "value"),
        "js_id": attr(row.first("input", "js-clipkey"), "value"),
        "href": attr(row.first("a", "js-cassette_link_href"), "href"),
        "floor": text(cells[2] if len(cells) > 2 else None),
        "rent_text": text(next(rent, None)),
        "management_fee_text": price("administration"),
        "deposit": price("deposit"),
        "gratuity": price("gratuity"),
        "layout": text(row.first("span", "cassetteitem_madori")),
        "size_text": text(row.first("span", "cassetteitem_menseki")),
        "thumbnail_url": attr(row.first("img", "casssetteitem_other-thumbnail-img"), "src"),
        "images": attr(row.first("div", "js-view_gallery_images"), "data-imgs"),
        "tags": [li.text() for li in _within(row, ("ul", "cassetteitem-taglist"), ("li", ""))],
    }


def rental_cards(page: Part) -> Iterator[dict]:
    """Rental buildings with their units."""
    for ordinal, card in enumerate(page.word(None, "cassetteitem")):
        storeys = [d.text() for d in _within(card, ("li", "cassetteitem_detail-col3"), ("div", ""))]
        label = _within(card, ("div", "cassetteitem_content-label"), ("span", "ui-pct"))
        image = _within(card, ("div", "cassetteitem_object-item"), ("img", ""))
        yield {
            "ordinal": ordinal,
            "image": attr(card.first("img"), "rel"),
            "type": text(next(label, None)),
            "title": text(card.first("div", "cassetteitem_content-title")),
            "address": text(card.first("li", "cassetteitem_detail-col1")),
            "image_src": attr(next(image, None), "src"),
            "age": storeys[0] if storeys else "",
            "floors": storeys[1] if len(storeys) > 1 else "",
            "stops": [d.text() for d in _within(card, ("li", "cassetteitem_detail-col2"), ("div", "cassetteitem_detail-text"))],
            "units": [_rental_unit(row) for row in card.each("tr", "js-cassette_link")],
        }


PROJECT = _record("ordinal source_id clip_key title href", "tags photos labels values accents prices descriptions")


def project_cards(page: Part) -> Iterator[dict]:
    """New-apartment cards with an id. ``ordinal`` counts all cards of the page."""
    for ordinal, card in enumerate(page.word("div", "cassette")):
        source_id = attr(card.first_word("input", "js-bsnckey"), "value")
        if not source_id:
            continue
        link, tags = card.first_word("a", "cassette_header-title"), card.first_word("p", "cassette_header-pct")
        photos = [a for word in ("js-cassette_thumbcarousel-item", "cassette_thumb-link") for a in card.word("a", word)]
        basics, phases = list(card.word("div", "cassette_basic-item")), list(card.word("li", "cassette_price-list_item"))
        said = lambda boxes, tag, word: [text(b.first_word(tag, word)) for b in boxes]
        yield {
            "ordinal": ordinal,
            "source_id": source_id,
            "clip_key": attr(card.first_word("input", "js-clipkey"), "value"),
            "title": text(link),
            "href": attr(link, "href"),
            "tags": [s.text() for s in tags.each("span")] if tags else [],
            "photos": [attr(a.first("img"), "rel") for a in photos],
            "labels": said(basics, "p", "cassette_basic-title"),
            "values": said(basics, "p", "cassette_basic-value"),
            "accents": said(phases, "span", "cassette_price-accent"),
            "prices": said(phases, "div", "cassette_price-value"),
            "descriptions": said(phases, "p", "cassette_price-description"),
        }


DETAIL = _record("", "hrefs labels values photos captions")


def _cell_text(cell: Part) -> str:
    """Text of a value cell: line breaks read as blanks, links to maps are left out."""
    hidden = [a for a in cell.each("a") if _MAP_CLASS.search(a.attr("class"))]
    shown = []
    for at in range(cell.start, cell.end):
        node = cell.nodes[at]
        if node["tag"] in ("#text", "br") and not any(a.start < at < a.end for a in hidden):
            shown.append(" " if node["tag"] == "br" else said(cell.nodes, at))
    return "".join(shown)


def details(page: Part) -> Iterator[dict]:
    """One record: the links, labelled values and photos of a detail page."""
    labels, values = [], []
    for th in page.each("th"):
        if any(word in DETAIL_LABEL_CLASSES for word in _BLANKS.split(th.attr("class"))):
            cell = th.following()
            labels.append((th.first("div") or th).text())
            values.append(_cell_text(cell) if cell and cell.nodes[cell.start]["tag"] == "td" else "")
    photos = list(page.each("img"))
    yield {
        "hrefs": [a.attr("href") for a in page.each("a")],
        "labels": labels,
        "values": values,
        "photos": [i.attr("rel") or i.attr("src") for i in photos],
        "captions": [i.attr("alt") for i in photos],
    }


PAGER = _record("hit box current", "pages")


def pager(page: Part) -> Iterator[dict]:
    """One record: what a list page's pager says, in either layout."""
    pagination = (b for b in _within(page, ("div", "pagination_set-nav"), ("ol", "pagination-parts")) if b.attr("class") == "pagination-parts")
    sortbox = (b for b in page.each("ol", "sortbox_pagination-parts") if b.attr("class") == "sortbox_pagination-parts")
    box = next(pagination, None) or next(sortbox, None)
    items = list(box.each("li")) if box else []
    now = ("pagination-current", "sortbox_pagination--current")
    current = next((li for li in items if any(word in now for word in _BLANKS.split(li.attr("class")))), None)
    yield {
        "hit": text(next((d for d in page.each("div", "pagination_set-hit") if d.attr("class") == "pagination_set-hit"), None)),
        "box": text(page.first_word("div", "hitbox-number")),
        "current": text(current),
        "pages": [text(li.first("a")) for li in items],
    }


LAYOUTS: dict[str, tuple[StructType, Callable[[Part], Iterator[dict]]]] = {
    "sale": (SALE, sale_cards), "rental": (RENTAL, rental_cards), "project": (PROJECT, project_cards), "detail": (DETAIL, details),
    "pager": (PAGER, pager),
}
_PAGES_AT_ONCE = 64


def _arrow(kind: DataType) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return pa.int32() if kind == IntegerType() else pa.string()


def html_extract(html: str, layout: str) -> Column:
    """The cards of a page in one layout, as an array of records of raw texts; null for no page."""
    schema, cards = LAYOUTS[layout]
    record = _arrow(schema)

    def some(pages: list[str | None]) -> pa.Array:
        """The cards of a few pages, field by field as flat arrays."""
        found, ends = [], [0]
        for page in pages:
            nodes = walked(page)
            if nodes is not None:
                found.extend(cards(Part(nodes, 0, len(nodes), getattr(nodes, "places", None), getattr(nodes, "found", None))))
            ends.append(len(found))
        fields = [pa.array([c[f.name] for c in found], f.type) for f in record]
        offsets = pa.array([None if p is None else e for p, e in zip(pages, ends)] + ends[-1:], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(record)))

    def extract(pages: pa.Array) -> pa.Array:
        """A batch is as large as the session says; its pages are taken a few at a time, so their cards never lie in memory together as
        Python objects."""
        parts = [some(pages[i : i + _PAGES_AT_ONCE].to_pylist()) for i in range(0, len(pages), _PAGES_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(record))

    return F.arrow_udf(extract, ArrayType(schema))(html)
