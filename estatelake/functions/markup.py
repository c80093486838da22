"""HTML as a column: a page becomes an array of its elements in document order, and selectors become filters on it.

The array is a nested set: every element knows its position and how many entries follow inside it, so the inside of an
element is one contiguous slice. Walking the markup is the only Python step and it yields strings only; everything
after it is array functions, needs no shuffle and stays visible to the optimizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

from estatelake.functions.text import trim_all

NODES = ArrayType(
    StructType()
    .add("pos", IntegerType())
    .add("parent", IntegerType())
    .add("size", IntegerType())
    .add("tag", StringType())
    .add("attrs", MapType(StringType(), StringType()))
    .add("text", StringType())
)
_ARROW_NODES = pa.list_(
    pa.struct(
        [
            ("pos", pa.int32()), ("parent", pa.int32()), ("size", pa.int32()), ("tag", pa.string()),
            ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
        ]
    )
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag is optional: opening one of the second ends an open first.
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
    "p": set("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article form footer header nav hr".split()),
}
_CLOSERS = frozenset().union(*_CLOSED_BY.values())
# The text in these is read by rules of its own, so their tags go through the parser every time.
_OWN_TEXT = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_TAGS_KEPT = 20_000
# An optional end never reaches out of these.
_FENCE = {"ul", "ol", "dl", "table", "html", "body", "div", "select", "article", "section"}


class _Entries:
    """Collects (pos, parent, size, tag, attrs, text, class) in document order; texts are entries tagged ``#text``."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def add(self, tag: str, attrs: list, text: str | None, classes: str = "") -> None:
        parent = self.open[-1] + 1 if self.open else 0
        self.nodes.append(
            {"pos": len(self.nodes) + 1, "parent": parent, "size": 0, "tag": tag, "attrs": attrs, "text": text, "class": classes}
        )

    def close_to(self, depth: int) -> None:
        for at in self.open[depth:]:
            self.nodes[at]["size"] = len(self.nodes) - at - 1
        del self.open[depth:]

    def start(self, tag: str, attrs: list, alone: bool, classes: str | None = None) -> None:
        if classes is None:
            classes = next((v for k, v in attrs if k == "class"), "")
        if tag in _CLOSERS:
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.nodes[self.open[depth]]["tag"]
                if tag in _CLOSED_BY.get(name, ()):
                    self.close_to(depth)
                elif name in _FENCE:
                    break
        self.add(tag, attrs, None, classes)
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)
            if alone:
                self.close_to(len(self.open) - 1)

    def end(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                self.close_to(depth)
                return


class _Walk(HTMLParser):
    """Reads any page into entries."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.entries = _Entries()
        self.read: tuple | None = None

    # Tags that a worker has read before, by their text: pages of a site repeat most of theirs.
    tags: dict[str, tuple] = {}

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted."""
        return j

    def parse_starttag(self, i: int) -> int:
        end = self.check_for_whole_start_tag(i)
        known = self.tags.get(self.rawdata[i:end]) if end >= 0 else None
        if known is not None:
            tag, attrs, alone = known
            self.entries.start(tag, attrs, alone)
            return end
        self.read = None
        after = super().parse_starttag(i)
        if self.read and after == end and self.read[0] not in _OWN_TEXT:
            if len(self.tags) >= _TAGS_KEPT:
                self.tags.clear()
            self.tags[self.rawdata[i:end]] = self.read
        return after

    def handle_starttag(self, tag: str, attrs: list, alone: bool = False) -> None:
        pairs = {k: v or "" for k, v in reversed(attrs)}
        self.read = tag, list(pairs.items())[::-1], alone
        self.entries.start(*self.read)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        self.entries.end(tag)

    def handle_data(self, data: str) -> None:
        self.entries.add("#text", [], data)


def parsed(html: str) -> list[dict]:
    """The entries of any page, by the parser."""
    walk = _Walk()
    walk.feed(html)
    walk.close()
    walk.entries.close_to(0)
    return walk.entries.nodes


_RAW_TEXT = frozenset(("script", "style"))
_PIECES = re.compile(r"(<[^>]*>)")
_END = re.compile(r"</([A-Za-z][-.A-Za-z0-9:_]*)\s*>")
_SILENT = re.compile(r"<!--(?:[^->]|-(?!-))*-->|<!(?i:doctype)[^<>]*>")
_ATTRIBUTE = r"""[A-Za-z_:][-\w:.]*(?:="[^"<>]*")?"""
_START = re.compile(rf"<([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+{_ATTRIBUTE})*)[ \t\n\r\f]*(/?)>", re.A)
_ATTRIBUTES = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:="([^"<>]*)")?""", re.A)
# Pieces between angle brackets as they were read.
_READ: dict[str, tuple] = {}


def _piece(text: str) -> tuple | None:
    """What a piece of plainly written markup says: its attributes, and its mark, which has all that the walk depends on: kind, tag, class,
    whether it ends at once and how a start is entered (1: nothing goes inside, 2: it only opens, 3: it only opens in an element that no
    optional end reaches out of, 0: by the rules). None for a piece that the parser has to look at."""
    start = _START.fullmatch(text)
    if start:
        tag = start[1].lower()
        if tag in _OWN_TEXT and tag != "title" and tag not in _RAW_TEXT:
            return None
        pairs = {k.lower(): unescape(v) for k, v in reversed(_ATTRIBUTES.findall(start[2]))}
        closer, alone = tag in _CLOSERS, start[3] and tag not in _VOID
        entered = 0 if alone or tag in _OWN_TEXT or (closer and tag in _VOID) else 3 if closer else 1 if tag in _VOID else 2
        return list(pairs.items())[::-1], ("start", tag, pairs.get("class", ""), bool(start[3] and entered != 1), entered)
    end = _END.fullmatch(text)
    if end:
        return None, ("end", end[1].lower(), "", False, 0)
    return (None, ("nothing", "", "", False, 0)) if _SILENT.fullmatch(text) else None


class Page(list):
    """Entries of a page. Where its frame is known, ``places`` has their positions by tag and ``found`` what was looked up in the
    frame, which all its pages share. With ``said`` the entries are the frame's own: ``attrs`` is the number of the entry's text in
    ``said`` or of its tag in ``read``."""

    places: dict[str, list[int]] | None = None
    found: dict | None = None
    said: list[str] | None = None
    read: list[tuple] | None = None


class _Frame:
    """The entries of all pages with the same marks and the same places of texts: (pos, parent, size, tag, class, number of its text or
    its tag). ``raw`` numbers the texts without references, ``places`` has the entries by tag."""

    __slots__ = ("entries", "raw", "places", "nodes", "found")

    def __init__(self, nodes: list[dict], raw: list[int]) -> None:
        self.nodes, self.found = [dict(n) for n in nodes], {}
        self.entries = [(n["pos"], n["parent"], n["size"], n["tag"], n["class"], n["attrs"]) for n in nodes]
        self.raw = raw
        self.places: dict[str, list[int]] = {}
        for at, node in enumerate(nodes):
            self.places.setdefault(node["tag"], []).append(at)


def _framed(marks: list[tuple], empty: list[bool]) -> tuple[list[dict], list[int]] | None:
    """Entries that have the number of their text or tag for attributes, and the numbers of texts without references; None for a page that
    the parser has to look at."""
    walk = _Entries()
    nodes, open_ = walk.nodes, walk.open
    raw, raws, count, parent = None, [], 0, 0
    for at, nothing in enumerate(empty):
        if not nothing:
            count += 1
            nodes.append({"pos": count, "parent": parent, "size": 0, "tag": "#text", "attrs": at, "text": None, "class": ""})
            if raw in _RAW_TEXT:
                raws.append(at)
        if at == len(marks):
            break
        kind, tag, classes, alone, plain = marks[at]
        if raw and (kind != "end" or tag != raw):
            return None
        raw = None
        if kind == "start":
            if plain == 3 and open_ and nodes[open_[-1]]["tag"] not in _FENCE:
                plain = 0
            if plain:
                count += 1
                nodes.append({"pos": count, "parent": parent, "size": 0, "tag": tag, "attrs": at, "text": None, "class": classes})
                if plain > 1:
                    open_.append(count - 1)
                    parent = count
            else:
                walk.start(tag, at, alone, classes)
                if tag in _OWN_TEXT:
                    if alone:
                        return None
                    raw = tag
                count, parent = len(nodes), open_[-1] + 1 if open_ else 0
        elif kind == "end":
            if open_ and nodes[open_[-1]]["tag"] == tag:
                last = open_.pop()
                nodes[last]["size"] = count - last - 1
            else:
                walk.end(tag)
            parent = open_[-1] + 1 if open_ else 0
    if raw:
        return None
    walk.close_to(0)
    return nodes, raws


# Frames of the pages a worker has read, by their marks: pages with one card or listing have few. Long pages repeat none.
_FRAMES: dict[tuple, _Frame] = {}
_FRAMES_KEPT, _FRAME_PIECES = 500, 600


def _plainly_walked(html: str, shared: bool = False) -> Page | None:
    """The entries of a page whose markup is written plainly throughout (attributes in double quotes, no stray brackets, in scripts
    neither), which needs no parser; None for any other page. ``shared`` gives the frame's own entries where a frame is known."""
    pieces = _PIECES.split(html)
    texts, tags = pieces[::2], pieces[1::2]
    if "<" in "".join(texts):
        return None
    read = [_READ.get(tag) for tag in tags]
    if None in read:
        for at, known in enumerate(read):
            if known is None:
                known = read[at] = _piece(tags[at])
                if known is None:
                    return None
                if len(_READ) >= _TAGS_KEPT:
                    _READ.clear()
                _READ[tags[at]] = known
    marks, empty = [mark for _, mark in read], [not text for text in texts]
    short = len(tags) <= _FRAME_PIECES
    key = (*marks, *empty) if short else ()
    frame = _FRAMES.get(key)
    said = [unescape(text) if "&" in text else text for text in texts]
    if frame is None:
        found = _framed(marks, empty)
        if found is None:
            return None
        nodes, raw = Page(found[0]), found[1]
        if short:
            if len(_FRAMES) >= _FRAMES_KEPT:
                _FRAMES.clear()
            frame = _FRAMES[key] = _Frame(nodes, raw)
            nodes.places, nodes.found = frame.places, frame.found
        for at in raw:
            said[at] = texts[at]
        for node in nodes:
            at = node["attrs"]
            if node["tag"] == "#text":
                node["attrs"], node["text"] = [], said[at]
            else:
                node["attrs"] = read[at][0]
        return nodes
    for at in frame.raw:
        said[at] = texts[at]
    if shared:
        nodes = Page(frame.nodes)
        nodes.places, nodes.found, nodes.said, nodes.read = frame.places, frame.found, said, read
        return nodes
    nodes = Page([
        {"pos": pos, "parent": parent, "size": size, "tag": tag, "attrs": [], "text": said[at], "class": ""}
        if tag == "#text"
        else {"pos": pos, "parent": parent, "size": size, "tag": tag, "attrs": read[at][0], "text": None, "class": classes}
        for pos, parent, size, tag, classes, at in frame.entries
    ])
    nodes.places = frame.places
    return nodes


def _walked(html: str | None, shared: bool) -> list[dict] | None:
    if html is None:
        return None
    nodes = _plainly_walked(html, shared)
    return parsed(html) if nodes is None else nodes


def walked(html: str | None) -> list[dict] | None:
    """Entries of a page as dicts with the fields of NODES."""
    return _walked(html, False)


def walked_shared(html: str | None) -> list[dict] | None:
    """The same for reading only: pages of a known frame come with the frame's own entries, see ``Page``."""
    return _walked(html, True)


def only_references(pages: Column, names: tuple[str, ...]) -> Column:
    """The pages with every ampersand outside scripts, styles and comments that begins no reference of the ``names``, closed by its
    semicolon, written as a reference itself, so that it reads as it stands: ``&amp`` or ``&quot;`` for the names lt, gt and amp."""
    passed = re.compile(rf"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|&(?!(?:{'|'.join(names)});)")
    spelled = lambda found: "&amp;" if found[0] == "&" else found[0]

    def spell(texts: pa.Array) -> pa.Array:
        return pa.array([t and passed.sub(spelled, t) for t in texts.to_pylist()], type=pa.string())

    return F.arrow_udf(spell, StringType())(pages)


_PAGES_AT_ONCE = 64


@F.arrow_udf(NODES)
def html_nodes(pages: pa.Array) -> pa.Array:
    """The page's elements and texts in document order. A batch is as large as the session says, so the pages become Arrow a few at a
    time and a worker never holds a batch's elements as Python objects."""
    parts = [pa.array([walked(p) for p in pages[i : i + _PAGES_AT_ONCE].to_pylist()], type=_ARROW_NODES) for i in range(0, len(pages), _PAGES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_ARROW_NODES)


Matcher = Callable[[Column], Column]


def attr(node: Column, name: str) -> Column:
    """Attribute text, '' where the element or the attribute is missing."""
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def let(value: Column, body: Matcher) -> Column:
    """``body`` of the value, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inside(nodes: Column, node: Column) -> Column:
    """The element and everything in it, as a slice of the array that holds it."""
    return let(node, lambda n: F.slice(nodes, n["pos"] - F.get(nodes, F.lit(0))["pos"] + 1, n["size"] + 1))


def parent_of(nodes: Column, node: Column) -> Column:
    """The enclosing element, null where it lies outside the array."""
    at = node["parent"] - F.get(nodes, F.lit(0))["pos"]
    return let(at, lambda i: F.when(i >= 0, F.get(nodes, F.greatest(i, F.lit(0)))))


def text_content(nodes: Column) -> Column:
    """All text of a slice, in order."""
    texts = F.filter(nodes, lambda n: n["tag"] == "#text")
    return F.coalesce(F.array_join(F.transform(texts, lambda n: n["text"]), ""), F.lit(""))


def text_of(nodes: Column, node: Column) -> Column:
    return F.coalesce(text_content(inside(nodes, node)), F.lit(""))


def trimmed_text_of(nodes: Column, node: Column) -> Column:
    return trim_all(text_of(nodes, node))


def has_tag(tag: str) -> Matcher:
    return lambda n: n["tag"] == tag


def class_contains(part: str) -> Matcher:
    """Substring of the class attribute, as the site's selectors use it."""
    return lambda n: F.contains(attr(n, "class"), F.lit(part))


def class_word(word: str) -> Matcher:
    """One whole class name."""
    return lambda n: attr(n, "class").rlike(rf"(^|\s){re.escape(word)}(\s|$)")


def both(*matchers: Matcher) -> Matcher:
    def match(n: Column) -> Column:
        result = matchers[0](n)
        for matcher in matchers[1:]:
            result = result & matcher(n)
        return result

    return match


def element(tag: str, class_part: str | None = None) -> Matcher:
    return both(has_tag(tag), class_contains(class_part)) if class_part else has_tag(tag)


def element_word(tag: str, word: str) -> Matcher:
    return both(has_tag(tag), class_word(word))


def descend(nodes: Column, *path: Matcher) -> Column:
    """Elements reached by the path, each step searched at and below the elements of the step before. An element
    reachable through two nested elements is listed twice."""
    if len(path) == 1:
        return F.filter(nodes, path[0])

    def walk(bound: Column) -> Column:
        found = F.filter(bound, path[0])
        for step in path[1:]:
            found = F.flatten(F.transform(found, _search(bound, step)))
        return found

    return let(nodes, walk)


def _search(nodes: Column, step: Matcher) -> Matcher:
    return lambda n: F.filter(inside(nodes, n), step)


def first(nodes: Column, *path: Matcher) -> Column:
    return F.get(descend(nodes, *path), F.lit(0))


# What a condition may ask of an element, by the text in front of its quoted value: a builder from the array that is searched
# and the value. ``@name`` with and without a value is read apart.
CONDITIONS: dict[str, Callable[[Column, str], Matcher]] = {
    "class~=": lambda nodes, value: lambda n: (attr(n, "class") != "") & class_contains(value)(n),
    "text()=": lambda nodes, value: lambda n: text_of(nodes, n) == value,
    "contains(text(),": lambda nodes, value: lambda n: F.contains(text_of(nodes, n), F.lit(value)),
}


def _attribute(name: str, value: str | None) -> Matcher:
    """An attribute that is there and not empty, with one value where one is asked for."""
    if value is None:
        return lambda n: attr(n, name) != ""
    return lambda n: (attr(n, name) == value) & F.lit(value != "")


def _condition(nodes: Column, text: str) -> Matcher | None:
    """The test behind the text between two brackets; none for a text of any other shape."""
    subject, quoted, rest = text.partition('"')
    value = rest.partition('"')[0] if quoted else None
    if subject.startswith("@"):
        return _attribute(subject[1:].removesuffix("="), value)
    builder = CONDITIONS.get(subject)
    return builder(nodes, value) if builder and value is not None else None


def _tokens(path: str) -> list[tuple[str, list[str]]] | None:
    """(tag, texts in brackets) of each step of a path whose steps start with ``//``, read in one pass; null where a character
    stands where none may."""
    steps: list[tuple[str, list[str]]] = []
    at = 0
    while at < len(path):
        if path.startswith("//", at):
            at += 2
            steps.append(("", []))
        elif path[at] == "[" and steps and steps[-1][0]:
            end = path.find("]", at)
            if end < 0:
                return None
            steps[-1][1].append(path[at + 1 : end])
            at = end + 1
        elif steps and not steps[-1][1] and (path[at].isalnum() or path[at] in "_-") and path[at].isascii():
            steps[-1] = (steps[-1][0] + path[at].lower(), steps[-1][1])
            at += 1
        else:
            return None
    return [step for step in steps if step[0]] or None


def selector(query: str) -> list[Callable[[Column], Matcher]] | None:
    """Steps of a ``//tag[@a="v"][@a][class~="x"][text()="t"][contains(text(),"t")]//…`` selector, or null where the
    text is not one. Each step takes the array it runs on, since text conditions look inside it.

    An attribute test needs a non-empty value, ``class~=`` is a substring match, and conditions of any other shape
    are ignored.
    """
    steps = _tokens((query or "").removeprefix("."))

    def step(tag: str, conditions: list[str]) -> Callable[[Column], Matcher]:
        return lambda nodes: both(has_tag(tag), *filter(None, (_condition(nodes, c) for c in conditions)))

    return [step(*s) for s in steps] if steps else None


def select(nodes: Column, query: str) -> Column:
    """Elements of the array that a selector text finds."""
    steps = selector(query)
    if not steps:
        return F.array().cast(NODES)
    return descend(nodes, *[step(nodes) for step in steps])
