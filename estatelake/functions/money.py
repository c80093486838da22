"""Prices and rents: Japanese price texts to yen, and yen to display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelake.fixed_values import RENT_BANDS
from estatelake.functions.text import digits


def _before(c: Column, mark: str, strict: bool) -> Column:
    at = F.instr(c, mark)
    keep = at - (1 if strict else 2)
    return F.when(at > 0, F.substr(c, F.lit(1), F.greatest(keep, F.lit(0)))).otherwise(c)


def parse_price(c: Column, strict: bool = False) -> Column:
    """Yen of a price text; a range counts by its lower end, an unreadable text as 0.

    The default keeps three habits of the listing site's stored prices: only one digit before 億 is read, thousands
    separators end the number, and the character before a range mark is lost. ``strict`` reads the text as written.
    """
    text = F.coalesce(c, F.lit(""))
    if strict:
        text = F.regexp_replace(text, ",", "")
    text = _before(_before(text, "～", strict), "・", strict)
    oku = digits(text, "([0-9]+)億" if strict else "([0-9])億")
    man = digits(text, "([0-9]+)万")
    sen = digits(text, "万([0-9])")
    return oku * 100_000_000 + man * 10_000 + sen * 1_000


def parse_rent(c: Column) -> Column:
    """Yen of a monthly amount such as 6.1万円 or 4000円; '-' and blank count as 0."""
    amount = F.regexp_replace(c, r"[^0-9.]", "").try_cast("decimal(20,6)")
    yen = F.when(F.contains(c, F.lit("万円")), amount * 10_000).otherwise(amount)
    return F.when(c.isNull() | c.isin("", "-"), F.lit(0).cast("long")).otherwise(
        F.coalesce(F.round(yen, 0).cast("long"), F.lit(0).cast("long"))
    )


def price_per_tsubo(c: Column) -> Column:
    amount = F.regexp_replace(F.regexp_extract(c, "([0-9,.]+)万円", 1), ",", "").try_cast("double")
    return F.when(c == "-", F.lit(0.0)).otherwise(F.coalesce(amount * 10_000, F.lit(0.0)))


def building_coverage(c: Column) -> Column:
    return digits(c, "建ぺい率[：・]([0-9]+)％", kind="int")


def floor_area_ratio(c: Column) -> Column:
    return digits(c, "容積率[：・]([0-9]+)％", kind="int")


def rent_band(c: Column) -> Column:
    """Index of the first band that holds the rent. Bands share their edges, so an edge belongs to the lower band."""
    band = F.lit(None).cast("int")
    for index in reversed(range(len(RENT_BANDS))):
        low, high, _ = RENT_BANDS[index]
        inside = c >= low if high is None else (c >= low) & (c <= high)
        band = F.when(inside, F.lit(index)).otherwise(band)
    return band


def rent_band_label(index: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for _, _, label in RENT_BANDS]), index)


def rent_choice(low: Column, high: Column) -> Column:
    """Name of a pair of rent bounds: ``any``, the index of the band with these bounds, or ``custom``."""
    choice = F.lit("custom")
    for index in reversed(range(len(RENT_BANDS))):
        band_low, band_high, _ = RENT_BANDS[index]
        same_high = high.isNull() if band_high is None else high.eqNullSafe(F.lit(band_high))
        choice = F.when((F.coalesce(low, F.lit(0)) == band_low) & same_high, F.lit(str(index))).otherwise(choice)
    return F.when(low.isNull() & high.isNull(), F.lit("any")).otherwise(choice)


def yen(c: Column) -> Column:
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("¥"), F.format_number(F.abs(c), 0))


def man(c: Column) -> Column:
    return F.concat(F.format_number(F.floor(c / 10_000 + F.lit(0.5)), 0), F.lit("万円"))


def short_yen(c: Column) -> Column:
    """¥1.1M from a million up, ¥800K below; halves round up."""
    tenths = F.floor((c + 50_000) / 100_000).cast("long")
    millions = F.concat(F.lit("¥"), F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("M"))
    return F.when(c >= 1_000_000, millions).otherwise(
        F.concat(F.lit("¥"), F.floor(c / 1_000 + F.lit(0.5)).cast("string"), F.lit("K"))
    )
