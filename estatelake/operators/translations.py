"""Texts to translate, the translation cache and the columns that show translations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import TEXTS_PER_REQUEST
from estatelake.functions.text import filled, name_key
from estatelake.operators.filters import needs_translation
from estatelake.operators.ordered import numbered


def distinct_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-blank texts of the columns as ``source_text``."""
    texts = F.explode(F.array_distinct(F.array(*[F.col(c) for c in columns]))).alias("source_text")
    return df.select(texts).where(F.trim("source_text") != "").distinct()


def missing_translations(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.join(cache.select("source_text"), "source_text", "left_anti")


def append_translations(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with the new translations; texts it already holds keep theirs, a text given twice counts once."""
    fresh = rows.groupBy("source_text").agg(F.min("translated_text").alias("translated_text"))
    return cache.unionByName(fresh.join(cache, "source_text", "left_anti"))


def decorate(df: DataFrame, columns: list[str], cache: DataFrame) -> DataFrame:
    """The columns with their cached translation, or the source text where there is none; '-' for no text.

    The texts are looked up once each: distinct values are joined to the cache, then back to the rows.
    """
    for c in columns:
        found = (
            df.select(F.col(c).alias("source_text")).where(filled(F.col(c)).isNotNull()).distinct()
            .join(cache, "source_text")
            .select(F.col("source_text").alias(c), F.col("translated_text").alias("_shown"))
        )
        shown = F.coalesce(filled(F.col("_shown")), filled(F.col(c)), F.lit("-"))
        df = df.join(found, c, "left").select(*[shown.alias(c) if x == c else F.col(x) for x in df.columns])
    return df


def translation_worklist(df: DataFrame) -> DataFrame:
    """(id, field, text) of every untranslated name and title."""
    todo = needs_translation(df)
    entry = lambda field, source, target: F.when(
        filled(F.col(source)).isNotNull() & filled(F.col(target)).isNull(),
        F.struct(F.lit(field).alias("field"), F.col(source).alias("text")),
    )
    entries = F.array_compact(
        F.array(
            entry("property_name", "property_name", "translated_property_name"), entry("title", "title", "translated_title")
        )
    )
    return todo.select("id", F.explode(entries).alias("e")).select("id", "e.*")


def assign_batches(df: DataFrame, size: int = TEXTS_PER_REQUEST, id: str = "id", order: list[str] = [], width: int = 100_000) -> DataFrame:
    """Adds ``batch``: consecutive rows by id, ``order`` and then all other columns, in groups of ``size``. Rows are
    counted per id range and per group of ranges, so no task numbers more than one range or sees all ranges."""
    rows = numbered(df, F.floor(F.col(id) / width), [id, *order], "_position")
    return rows.withColumn("batch", F.floor((F.col("_position") - 1) / size).cast("long")).drop("_position")


def translate(texts: DataFrame, translator: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Translations of distinct texts by the caller's function, which sees one Arrow batch of texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"source_text": batch["source_text"], "translated_text": translator(batch["source_text"])}
            )

    out = texts.select("source_text").mapInPandas(run, "source_text string, translated_text string")
    return out.where(F.col("translated_text").isNotNull())


def apply_translations(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Writes (id, field, text) translations to the translated columns they belong to; others keep their value."""
    pick = lambda field: F.max(F.when(F.col("field") == field, F.col("text")))
    per_id = rows.groupBy("id").agg(pick("property_name").alias("_name"), pick("title").alias("_title"))
    new = {"translated_property_name": "_name", "translated_title": "_title"}
    return df.join(per_id, "id", "left").select(
        *[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in df.columns]
    )


def new_names(stops: DataFrame, line: DataFrame, station: DataFrame) -> DataFrame:
    """(type, name) of line and station names that are not stored yet. A station counts as new unless its own line
    holds it."""
    keyed = stops.select("line", "station").distinct().select(
        "line", "station", name_key(F.col("line")).alias("line_key"), name_key(F.col("station")).alias("station_key")
    )
    lines = line.select(F.col("id").alias("train_line_id"), name_key(F.col("name")).alias("line_key"))
    unknown_lines = keyed.join(lines, "line_key", "left_anti").select(F.lit("line").alias("type"), F.col("line").alias("name"))
    held = station.select("train_line_id", name_key(F.col("name")).alias("station_key")).join(lines, "train_line_id")
    unknown_stations = keyed.join(held, ["line_key", "station_key"], "left_anti").select(
        F.lit("station").alias("type"), F.col("station").alias("name")
    )
    return unknown_lines.unionByName(unknown_stations).distinct()


def names_to_translate(new: DataFrame, decisions: DataFrame) -> DataFrame:
    """New names without the lines that got a canonical name, which is shown instead of a translation."""
    named = decisions.where(filled(F.col("canonical_name")).isNotNull()).select(F.lit("line").alias("type"), "name")
    return new.join(named, ["type", "name"], "left_anti")


def shown_name(translated: Column, name: Column) -> Column:
    return F.coalesce(filled(translated), name)
