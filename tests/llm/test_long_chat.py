"""Texts longer than the JSON reader's default limit."""

from pyspark.sql import functions as F

from estatelake.llm import chat


def test_texts_above_twenty_million_characters_come_through(spark):
    text = F.when(F.col("turn") == 1, F.repeat(F.lit("x"), 20_500_000)).otherwise(F.lit("short"))
    rows = spark.range(2).select(F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("user").alias("role"), text.alias("text"))
    got = chat.canonical_turns(chat.records_of_rows(rows, "c", "turn")).select("layout", F.transform("turns", lambda t: F.length(t.text)).alias("n")).first()
    assert (got.layout, got.n) == ("messages", [5, 20_500_000])
