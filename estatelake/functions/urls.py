"""URLs of pages and photos. The listing site's own hosts are arguments; nothing here names one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelake.fixed_values import PHOTO_SIZE, RENTAL_URL_MARKS, RESIZE_PATH


def absolute_url(c: Column, origin: str) -> Column:
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit(origin), c))


def without_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def classify_page(url: Column) -> Column:
    rental = F.lit(False)
    for mark in RENTAL_URL_MARKS:
        rental = rental | F.contains(url, F.lit(mark))
    return F.when(rental, F.lit("rental")).otherwise(F.lit("sale"))


def allowed_url(url: Column, host: str, subdomains: bool = True) -> Column:
    """https and on the host itself (or, with ``subdomains``, below it)."""
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    on_host = name == host.lower()
    if subdomains:
        on_host = on_host | F.endswith(name, F.lit("." + host.lower()))
    https = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.coalesce(https & on_host, F.lit(False))


def pinned_photo_url(url: Column) -> Column:
    """A resize URL asks for the one size shown; other URLs stay as they are."""
    width, height = PHOTO_SIZE
    pinned = url
    for key, value in (("w", width), ("h", height)):
        present = pinned.rlike(rf"[?&]{key}=")
        pinned = F.when(present, F.regexp_replace(pinned, rf"(?<=[?&]{key}=)[^&]*", str(value))).otherwise(
            F.concat(pinned, F.when(F.contains(pinned, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{key}={value}"))
        )
    return F.when(F.try_parse_url(url, F.lit("PATH")) == RESIZE_PATH, pinned).otherwise(url)


def photo_key(url: Column) -> Column:
    """Identity of a photo: the decoded source file in its resize URL."""
    source = F.regexp_extract(url, "src=([^&]+)", 1)
    return F.when(source != "", F.try_url_decode(source))


def outline_url(page_url: Column) -> Column:
    """Address of the outline sub-page that belongs to a detail page."""
    path = F.regexp_replace(page_url, r"[?#].*$", "")
    return F.concat(F.regexp_replace(path, "/$", ""), F.lit("/property/"))
