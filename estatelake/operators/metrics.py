"""Counters of an ingest run and the page after which a section has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelake.fixed_values import CAUGHT_UP_PAGES


def _status_counts() -> list:
    return [
        F.count("*").alias("items"),
        *[F.count_if(F.col("metric_status") == s).alias(f"{s}_items") for s in ("new", "updated", "unchanged")],
    ]


def observed(classified: DataFrame, observation: Observation) -> DataFrame:
    """The same rows, counted by status on their way to wherever they are written. The counters are in
    ``observation.get`` once that write is done, at no cost of a second pass."""
    return classified.observe(observation, *_status_counts())


def page_metrics(classified: DataFrame, keys: list[str] = ["section_key", "page"]) -> DataFrame:
    """Items per page by status. Rows of buildings without a key have no status but count as items; a row whose ``item`` is
    false stands for a page without items."""
    counts = _status_counts()
    if "item" in classified.columns:
        counts[0] = F.count_if("item").alias("items")
    return classified.groupBy(*keys).agg(*counts)


def ingest_metrics(classified: DataFrame, section: str = "section_key", page: str = "page") -> DataFrame:
    """The same counters per page, per section (page null) and for the run (both null), with the pages they cover."""
    pages = page_metrics(classified, [section, page])
    counters = ["items", "new_items", "updated_items", "unchanged_items"]
    return pages.rollup(section, page).agg(*[F.sum(c).alias(c) for c in counters], F.count("*").alias("pages"))


def caught_up_page(pages: DataFrame, threshold: int = CAUGHT_UP_PAGES, section: str = "section_key") -> DataFrame:
    """Page after which each section stops, and why: ``caught-up`` at the end of the first run of ``threshold``
    unchanged pages, ``no-items`` at the first empty page, else ``completed`` at its last page.

    Takes page metrics. A section has at most as many pages as the page cap, so its window is bounded.
    """
    in_order = W.partitionBy(section).orderBy("page")
    changed = (F.col("new_items") + F.col("updated_items") > 0).cast("int")
    runs = pages.withColumn("_run", F.sum(changed).over(in_order))
    inside = W.partitionBy(section, "_run").orderBy("page")
    still = F.col("new_items") + F.col("updated_items") == 0
    counted = runs.withColumn("_still", F.sum(still.cast("int")).over(inside))
    empty = F.min(F.when(F.col("items") == 0, F.col("page")))
    done = F.min(F.when((F.col("_still") >= threshold) & still & (F.col("items") > 0), F.col("page")))
    ends = counted.groupBy(section).agg(empty.alias("_empty"), done.alias("_done"), F.max("page").alias("_last"))
    caught = F.col("_done").isNotNull() & (F.col("_empty").isNull() | (F.col("_done") < F.col("_empty")))
    return ends.select(
        section,
        F.when(caught, F.col("_done")).otherwise(F.coalesce("_empty", "_last")).alias("stop_page"),
        F.when(caught, "caught-up").when(F.col("_empty").isNotNull(), "no-items").otherwise("completed").alias("stop_reason"),
    )


def section_summary(sections: DataFrame, metrics: DataFrame, stops: DataFrame) -> DataFrame:
    """One stored row per section: planned pages, pages and items up to the stop page, and the stop reason."""
    seen = metrics.join(stops, "section_key").where(F.col("page") <= F.col("stop_page"))
    totals = seen.groupBy("section_key").agg(
        F.count("*").cast("int").alias("pages_fetched"),
        F.sum("items").cast("int").alias("items_processed"),
        F.sum("new_items").cast("int").alias("new_items"),
        F.sum("updated_items").cast("int").alias("updated_items"),
    )
    return sections.join(totals, "section_key", "left").join(stops.drop("stop_page"), "section_key", "left")


def run_totals(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("run_id").agg(
        F.sum("items_processed").alias("items"), F.sum("pages_fetched").alias("pages"),
        F.sum("new_items").alias("new_items"), F.sum("updated_items").alias("updated_items"),
    )


def scope_labels(runs: DataFrame, types: DataFrame, areas: DataFrame) -> DataFrame:
    """Runs with the names of their type, region and province; an id without a name stands for itself."""
    region = areas.select("region", "region_name").distinct()
    province = areas.select("province", "province_name")
    named = (
        runs.join(types.select("type", "type_name"), "type", "left").join(region, "region", "left").join(province, "province", "left")
    )
    return named.select(
        *runs.columns,
        F.coalesce("type_name", "type").alias("type_label"),
        F.coalesce("region_name", "region").alias("region_label"),
        F.coalesce("province_name", "province").alias("province_label"),
    )
