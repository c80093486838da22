"""The canonical rail-line reference set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.functions.text import filled


def read_canonical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the JSON array in file order (``ord``); rows without an id are dropped.

    The reference set is one small file, read by one task, so the running number follows the file.
    """
    raw = spark.read.schema(
        "code string, ekidata_id string, name_kanji string, name_kana string, name_romaji string, "
        "alternative_names array<string>, prefectures array<string>"
    ).json(path, multiLine=True)
    return raw.withColumn("ord", F.monotonically_increasing_id()).where(filled(F.col("ekidata_id")).isNotNull())


def merge_canonical(df: DataFrame) -> DataFrame:
    """One row per id. The first row's names win, the first code found is kept, the romaji name is taken from the
    first row that has a real one, and alternative names and prefectures are united in order of first appearance."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(
        "ekidata_id", "ord", blank("code").alias("code"), blank("name_kanji").alias("name_kanji"),
        blank("name_kana").alias("name_kana"), blank("name_romaji").alias("name_romaji"),
        "alternative_names", "prefectures",
    )
    first = lambda c: F.min_by(c, "ord").alias(c)
    heads = rows.groupBy("ekidata_id").agg(
        F.min("ord").alias("ord"), first("name_kanji"), first("name_kana"),
        F.min_by("name_romaji", "ord").alias("_own"),
        F.min_by("code", F.when(F.col("code") != "", F.col("ord"))).alias("code"),
    )
    # The own romaji name stands unless it is empty or just repeats the kanji; then the first real one replaces it.
    # A later name that again repeats the kanji may be replaced once more, hence "real" means unequal to the kanji.
    romaji = (
        rows.join(heads.select("ekidata_id", F.col("name_kanji").alias("_kanji")), "ekidata_id")
        .where(F.col("name_romaji") != "")
        .groupBy("ekidata_id")
        .agg(
            F.min_by("name_romaji", F.when(F.col("name_romaji") != F.col("_kanji"), F.col("ord"))).alias("_real"),
        )
    )
    merged = heads.join(romaji, "ekidata_id", "left").select(
        "ekidata_id", "ord", F.coalesce("code", F.lit("")).alias("code"), "name_kanji", "name_kana",
        F.when((F.col("_own") != "") & (F.col("_own") != F.col("name_kanji")), F.col("_own"))
        .otherwise(F.coalesce("_real", "name_kanji")).alias("name_romaji"),
    )
    for column in ("alternative_names", "prefectures"):
        # Repeated values are folded before the shuffle; only distinct ones are gathered per id.
        seen = (
            rows.select("ekidata_id", "ord", F.posexplode(column).alias("pos", "value"))
            .where(filled(F.col("value")).isNotNull())
            .groupBy("ekidata_id", "value")
            .agg(F.min(F.struct("ord", "pos")).alias("at"))
            .groupBy("ekidata_id")
            .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_seen"))
            .select("ekidata_id", F.col("_seen.value").alias(column))
        )
        merged = merged.join(seen, "ekidata_id", "left").withColumn(
            column, F.coalesce(column, F.array().cast("array<string>"))
        )
    return merged
