"""Stored pages and the plan of pages to crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.fixed_values import (
    NEW_APARTMENT_TYPE, PAGE_SIZES, PAGE_URLS, RENTAL_TYPE,
)
from estatelake.sources.dims import listing_types, prefectures


def read_pages(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    pages = spark.read.parquet(path)
    return pages.where(F.col("kind") == kind) if kind else pages


def section_plan(
    types: DataFrame, areas: DataFrame, type: str | None = None, region: str | None = None, province: str | None = None
) -> DataFrame:
    """One row per (listing type, prefecture), each optionally fixed to one value.

    Every type lists the same areas, so the areas are exploded from one array per type: the list of areas is a
    dimension of fixed size and no table is joined to another.
    """
    chosen = areas
    if region:
        chosen = chosen.where(F.col("region") == region)
    if province:
        chosen = chosen.where(F.col("province") == province)
    listed = chosen.agg(F.array_sort(F.collect_list(F.struct("ord", "region", "province"))).alias("areas"))
    wanted = types.where(F.col("type") == type) if type else types
    return (
        wanted.select(F.col("ord").alias("type_ord"), "type", F.explode(listed.scalar()).alias("area"))
        .select(
            "type",
            F.col("area.region").alias("region"),
            F.col("area.province").alias("province"),
            F.concat_ws("-", "area.region", "area.province", "type").alias("section_key"),
            (F.col("type_ord") * 10_000 + F.col("area.ord")).alias("ord"),
        )
    )


def default_section_plan(spark: SparkSession, **only: str) -> DataFrame:
    return section_plan(listing_types(spark), prefectures(spark), **only)


def page_counts(sections: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages of each section from its item total and the last page its pager showed (columns ``total_items`` and
    ``scraped_pages``); the pager under-reports, so it is only a floor. Where a caller sets ``max_pages``, the column
    ``pages_left_out`` says how many pages that cuts off."""
    size = F.when(F.col("type") == RENTAL_TYPE, PAGE_SIZES["rental"]).otherwise(PAGE_SIZES["sale"])
    computed = F.ceil(F.col("total_items") / size).cast("int")
    counted = sections.withColumn("computed_pages", F.when(F.col("total_items") > 0, computed).otherwise(0))
    pages = F.greatest(F.col("scraped_pages"), F.col("computed_pages"), F.lit(1)).cast("int")
    if max_pages is None:
        return counted.withColumn("total_pages", pages)
    return counted.withColumns(
        {"total_pages": F.least(pages, F.lit(max_pages)), "pages_left_out": F.greatest(pages - max_pages, F.lit(0))}
    )


def page_url(site: str):
    """URL of a list page from the columns type, region, province and page."""
    template = (
        F.when(F.col("type") == RENTAL_TYPE, PAGE_URLS["rental"])
        .when(F.col("type") == NEW_APARTMENT_TYPE, PAGE_URLS["new_apartment"])
        .otherwise(PAGE_URLS["sale"])
    )
    url = F.replace(template, F.lit("{site}"), F.lit(site))
    for mark, column in (("{area}", "region"), ("{type}", "type"), ("{page}", "page"), ("{province}", "province")):
        url = F.replace(url, F.lit(mark), F.col(column).cast("string"))
    return url


def page_plan(sections: DataFrame, site: str, max_pages: int | None = None) -> DataFrame:
    """One row per page to fetch."""
    pages = page_counts(sections, max_pages).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("total_pages"))))
    return pages.withColumn("url", page_url(site))
