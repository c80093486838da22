"""Display labels: ages, durations, buckets and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelake.fixed_values import COUNT_THRESHOLDS
from estatelake.functions.text import first_filled, split_csv


def _n(c: Column) -> Column:
    return c.cast("string")


def age_days(ts: Column, as_of: Column) -> Column:
    return F.floor(F.timestamp_diff("SECOND", ts, as_of) / 86_400).cast("long")


def age_label(ts: Column, as_of: Column) -> Column:
    days = age_days(ts, as_of)
    return (
        F.when(days == 0, F.lit("today"))
        .when(days == 1, F.lit("1 day ago"))
        .when(days < 7, F.concat(_n(days), F.lit(" days ago")))
        .when(days < 14, F.lit("1 week ago"))
        .when(days < 30, F.concat(_n(F.floor(days / 7)), F.lit(" weeks ago")))
        .when(days < 60, F.lit("1 month ago"))
        .otherwise(F.concat(_n(F.floor(days / 30)), F.lit(" months ago")))
    )


def duration_label(start: Column, end: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.when(end.isNull(), F.lit("In progress")).otherwise(
        F.concat(_n(F.floor(seconds / 60)), F.lit("m "), _n(F.pmod(seconds, F.lit(60))), F.lit("s"))
    )


def count_bucket(c: Column) -> Column:
    """Legend bucket of a count: how many thresholds it reaches."""
    bucket = F.lit(0)
    for threshold in COUNT_THRESHOLDS:
        bucket = bucket + (c >= threshold).cast("int")
    return bucket


def bucket_label(bucket: Column) -> Column:
    marks = F.array(*[F.lit(f"{t:,}+") for t in COUNT_THRESHOLDS])
    return F.when(bucket == 0, F.lit(f"< {COUNT_THRESHOLDS[0]:,}")).otherwise(F.get(marks, bucket - 1))


def listing_name(translated: Column, name: Column, address: Column) -> Column:
    return F.coalesce(first_filled(translated, name), address)


def building_name(title: Column, address: Column) -> Column:
    return F.coalesce(first_filled(title), address)


def percent_of(count: Column, highest: Column) -> Column:
    """Bar length in percent of the highest count, never below 3."""
    share = F.floor(count * 100 / F.greatest(highest, F.lit(1)) + F.lit(0.5))
    return F.greatest(share, F.lit(3)).cast("long")


def photo_count(main_image: Column, extra_csv: Column) -> Column:
    return F.when(first_filled(main_image).isNotNull(), 1).otherwise(0) + F.size(split_csv(extra_csv))


def gallery(main_image: Column, extras: Column, detail_photos: Column) -> Column:
    """Photos of a listing: those of its detail page where it has any, else the main image and the extras."""
    own = F.filter(
        F.concat(F.array(main_image), F.coalesce(extras, F.array().cast("array<string>"))),
        lambda u: F.coalesce(F.trim(u) != "", F.lit(False)),
    )
    return F.when(F.size(detail_photos) > 0, detail_photos).otherwise(own)
