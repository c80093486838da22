"""Addresses and prefectures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelake.fixed_values import PREFECTURES_JA, REGIONS
from estatelake.functions.text import first_filled, trim_all


def _literal_map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def prefecture_code(name: Column) -> Column:
    """JIS code ``01``..``47`` of an exact prefecture name, else null."""
    codes = _literal_map([(p, f"{i:02d}") for i, p in enumerate(PREFECTURES_JA, 1)])
    return F.try_element_at(codes, name)


def prefecture_name(code: Column) -> Column:
    names = _literal_map([(f"{i:02d}", p) for i, p in enumerate(PREFECTURES_JA, 1)])
    return F.try_element_at(names, code)


def region_of(code: Column) -> Column:
    regions = [(f"{first + i:02d}", rid) for rid, _, first, names in REGIONS for i in range(len(names))]
    return F.try_element_at(_literal_map(regions), code)


def parse_address(c: Column) -> Column:
    """Struct (province, city, district). All empty where no prefecture leads the address.

    A 郡…町/村 pair is the city; otherwise the city ends at the first 市, else 区, else 町, else 村 of the text.
    """
    address = F.coalesce(c, F.lit(""))
    province = F.regexp_extract(address, "^(" + "|".join(PREFECTURES_JA) + ")", 1)
    rest = F.substr(address, F.length(province) + 1)
    county = F.regexp_extract(rest, "^(.+?郡.+?[町村])", 1)
    city = first_filled(county)
    for suffix in ("市", "区", "町", "村"):
        at = F.instr(rest, suffix)
        city = F.coalesce(city, F.when(at > 0, F.substr(rest, F.lit(1), at)))
    city = F.coalesce(city, F.lit(""))
    found = province != ""
    return F.struct(
        province.alias("province"),
        F.when(found, city).otherwise("").alias("city"),
        F.when(found, trim_all(F.substr(rest, F.length(city) + 1))).otherwise("").alias("district"),
    )


def complete_address(address: Column, searched_code: Column) -> Column:
    """Puts the searched prefecture in front of an address that leaves it out."""
    prefix = prefecture_name(searched_code)
    bare = (address != "") & (parse_address(address)["province"] == "") & prefix.isNotNull()
    return F.when(bare, F.concat(prefix, address)).otherwise(address)


def address_line(district: Column, city: Column, state: Column) -> Column:
    return F.concat_ws(", ", first_filled(district), first_filled(city), first_filled(state))
