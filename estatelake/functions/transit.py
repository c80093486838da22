"""Stations, lines and the similarity of their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelake.fixed_values import (
    BUS_CODE_SEPARATOR, BUS_EMBEDDED_CODE, BUS_PATTERNS, BUS_ROUTE_CODE, NAME_CUTS, STRONG_MATCH,
)
from estatelake.functions.text import digits, first_filled, trim_all


def _stop(line: Column, station: Column, minutes: Column) -> Column:
    return F.struct(
        line.alias("line"), station.alias("station"), minutes.cast("int").alias("walking_minutes")
    )


def parse_station(c: Column) -> Column:
    """``JR山手線「渋谷」徒歩8分`` → (line, station, walking_minutes)."""
    text = F.coalesce(c, F.lit(""))
    name = "([^「]+)「([^」]+)」"
    return _stop(
        F.regexp_extract(text, name, 1), F.regexp_extract(text, name, 2), digits(text, "(徒歩|歩)([0-9]+)分", 2, "int")
    )


def parse_station_info(c: Column) -> Column:
    """``地下鉄南北線/幌平橋駅 歩24分``: the first blank parts the place from the walk."""
    text = F.coalesce(c, F.lit(""))
    place = F.split_part(text, F.lit(" "), F.lit(1))
    walk = F.split_part(text, F.lit(" "), F.lit(2))
    return _stop(
        F.split_part(place, F.lit("/"), F.lit(1)),
        F.split_part(place, F.lit("/"), F.lit(2)),
        digits(walk, "歩([0-9]+)分", kind="int"),
    )


def parse_access(c: Column) -> Column:
    """``東急東横線/祐天寺 徒歩3分``; a range of minutes counts by its first figure."""
    text = F.coalesce(c, F.lit(""))
    route = r"(?U)^([^/]+)/(\S+)"
    return _stop(
        trim_all(F.regexp_extract(text, route, 1)),
        trim_all(F.regexp_extract(text, route, 2)),
        digits(text, "徒歩([0-9]+)分", kind="int"),
    )


def bare_name(folded: Column) -> Column:
    """Line name without brackets, destinations and station suffixes; takes a name that is already NFKC folded."""
    name = folded
    for pattern in NAME_CUTS:
        name = F.regexp_replace(name, pattern, "")
    return trim_all(name)


def looks_like_bus(folded: Column) -> Column:
    """True where a (folded) transit label reads like a bus route or stop rather than a railway line."""
    compact = F.regexp_replace(folded, r"(?U)\s", "")
    hit = compact.rlike(BUS_ROUTE_CODE) | (compact.rlike(BUS_EMBEDDED_CODE) & compact.rlike(BUS_CODE_SEPARATOR))
    for pattern in BUS_PATTERNS:
        hit = hit | folded.rlike(pattern)
    return F.coalesce(hit & (folded != ""), F.lit(False))


def bigrams(c: Column) -> Column:
    """Distinct two-character pieces; a one-character text is its own piece."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    return F.when(F.length(c) > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    ga, gb = bigrams(a), bigrams(b)
    shared = F.size(F.array_intersect(ga, gb))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.lit(2.0) * shared / (F.size(ga) + F.size(gb)))
    )


def transit_kind(folded: Column, best_score: Column) -> Column:
    """Kind decided without outside help: bus when nothing canonical is close and the label reads like a bus."""
    weak = F.coalesce(best_score, F.lit(0.0)) < STRONG_MATCH
    return F.when(weak & looks_like_bus(folded), F.lit("bus")).otherwise(F.lit("unknown"))


def fallback_kind(folded: Column) -> Column:
    return F.when(looks_like_bus(folded), F.lit("bus")).otherwise(F.lit("unknown"))


def line_label(canonical_name: Column, translated_name: Column, name: Column) -> Column:
    return F.coalesce(first_filled(canonical_name, translated_name), name)
