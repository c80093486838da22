"""Areas: texts to square metres, and the figures derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"


def parse_area(c: Column) -> Column:
    """Square metres before ㎡ (or else before the first m): 0 for no text, NaN where no number leads."""
    square, metre = F.instr(c, "㎡"), F.instr(c, "m")
    end = F.when(square > 0, square).otherwise(metre)
    number = F.regexp_extract(F.substr(c, F.lit(1), F.greatest(end - 1, F.lit(0))), LEADING_NUMBER, 1)
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(
        F.coalesce(number.try_cast("double"), F.lit(float("nan")))
    )


def parse_size(c: Column, strict: bool = False) -> Column:
    """Square metres of a unit. The default keeps every digit of the text (``40.16m2`` reads 40.162, as stored by the
    site's own readers); ``strict`` reads the leading number only."""
    text = F.regexp_extract(c, LEADING_NUMBER, 1) if strict else F.regexp_replace(c, r"[^0-9.]", "")
    number = F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double")
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(F.coalesce(number, F.lit(float("nan"))))


def known(c: Column, kind: str = "double") -> Column:
    """The number, or 0 where it is null or NaN: 0 stands for unknown in every stored figure."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).cast(kind)


def floor_area(building_area: Column, area: Column) -> Column:
    return F.when(building_area > 0, building_area).otherwise(area)


def unit_price(price: Column, building_area: Column, area: Column) -> Column:
    size = floor_area(building_area, area)
    return F.when(size > 0, F.floor(price / size + F.lit(0.5)).cast("long"))


def sqm(c: Column) -> Column:
    return F.concat(F.call_function("format_number", F.round(c, 1), F.lit("#,##0.#")), F.lit(" m²"))
