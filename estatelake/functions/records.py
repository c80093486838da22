"""Semi-structured columns: stations as JSON, run logs as string maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import RUN_STATUSES

STATIONS = "array<struct<line:string,station:string,walking_minutes:int>>"


def stations_from_json(c: Column) -> Column:
    """Stored stations; null, malformed and non-array texts read as no stations."""
    parsed = F.from_json(F.when(F.ltrim(c).startswith("["), c), STATIONS)
    return F.coalesce(parsed, F.array().cast(STATIONS))


def map_to_json(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.to_json(c)).otherwise("{}")


def normalise_status(df: DataFrame, fields: str) -> DataFrame:
    """Typed columns of a run log stored as a map of texts. Empty maps are no status and yield no row."""
    value = lambda key: F.try_element_at(F.col(fields), F.lit(key))
    number = lambda key: F.coalesce(F.regexp_extract(value(key), r"^\s*(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    return df.where(F.size(fields) > 0).select(
        *[c for c in df.columns if c != fields],
        F.when(value("status").isin(RUN_STATUSES), value("status")).otherwise("unknown").alias("status"),
        F.coalesce(value("message"), F.lit("")).alias("message"),
        number("itemsProcessed").alias("items_processed"),
        number("itemsTotal").alias("items_total"),
        number("sectionsToFetch").alias("sections_to_fetch"),
        number("sectionsProcessed").alias("sections_processed"),
        value("startTime").try_cast("timestamp").alias("start_time"),
        value("endTime").try_cast("timestamp").alias("end_time"),
        F.when(value("error") != "", value("error")).alias("error"),
    )
