"""Benchmark decontamination over a positional inverted index of the training texts.

The words of the documents are stored once. The index keeps (term, row, position) of the terms that are needed: for each window
of a benchmark item its rarest terms in the corpus. Lists are shifted by the term's offset in the item; where the shifted lists
of a window's rarest terms meet in one alignment of item and document, the window's other words are compared in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_DOCUMENTS = 1_000_000  # row ids of documents up to which they are broadcast
BROADCAST_ROWS = 200_000  # rows of benchmark side tables (a few short columns) up to which they are broadcast


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; other letters stay as they are. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def _side(df: DataFrame, rows: int) -> DataFrame:
    """A benchmark table of a counted size, broadcast while that is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tokenised(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns, ``words`` and an id of the row, written once. The id is part of the written rows, so it stays."""
    return stored(df.select(F.monotonically_increasing_id().alias("row"), *keep, words_of(F.col(text)).alias("words")))


def postings(tokens: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """(term, row, pos) of the given distinct terms."""
    every = tokens.select("row", F.posexplode("words").alias("pos", "term"))
    return every.join(_side(terms, rows), "term").select("term", "row", "pos")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item, start, length) of every window; an item of fewer words is one window."""
    n = F.size("words")
    return items.where(n > 0).select(
        F.col("row").alias("item"), F.explode(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).alias("start"),
        F.least(n, F.lit(size)).alias("length"),
    )


def phrase_hits(tokens: DataFrame, items: DataFrame, size: int = 10, rarest: int = 2) -> DataFrame:
    """(row, item, start, length): every occurrence of a window of an item in a row of ``tokens``, in words.

    Both inputs come from ``tokenised``. Windows with a term that the corpus does not have are dropped at once. Join keys are
    terms (against benchmark tables only) and then single alignments of one item with one document, so a passage that a third
    of the documents hold is spread like any other.
    """
    in_items = stored(items.select(F.col("row").alias("item"), F.posexplode("words").alias("offset", "term")))
    rows = in_items.count()
    frequency = stored(postings(tokens, in_items.select("term").distinct(), rows).groupBy("term").agg(F.count("*").alias("n")))
    placed = in_items.join(frequency, "term")
    each = windows_of(items, size).select("item", "start", "length", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("offset"))
    per_window = Window.partitionBy("item", "start")
    ranked = each.join(placed, ["item", "offset"]).withColumns({
        "rank": F.row_number().over(per_window.orderBy("n", "offset")), "present": F.count("*").over(per_window),
    })
    chosen = stored(ranked.where((F.col("present") == F.col("length")) & (F.col("rank") <= rarest)))
    lists = chosen.select("term", "item", "offset").distinct()
    index = stored(postings(tokens, chosen.select("term").distinct(), rows))
    needed = chosen.groupBy("item", "start", "length").agg(F.collect_set("offset").alias("need")).groupBy("item").agg(
        F.collect_list(F.struct("start", "length", "need")).alias("windows"), F.min(F.size("need")).alias("least")
    ).join(items.select(F.col("row").alias("item"), F.col("words").alias("item_words")), "item")
    aligned = index.join(_side(lists, rows), "term").select("item", "row", (F.col("pos") - F.col("offset")).alias("shift"), "offset")
    met = aligned.groupBy("item", "row", "shift").agg(F.collect_set("offset").alias("met"))
    fits = F.filter("windows", lambda w: F.size(F.array_except(w.need, F.col("met"))) == 0)
    candidates = met.join(_side(needed, rows), "item").where(F.size("met") >= F.col("least")).select(
        "item", "row", "shift", "item_words", fits.alias("windows")
    ).where(F.size("windows") > 0)
    same = lambda w: (F.col("shift") + w.start >= 0) & (
        F.slice("words", F.greatest(F.col("shift") + w.start, F.lit(0)) + 1, w.length) == F.slice("item_words", w.start + 1, w.length)
    )
    candidates = stored(candidates)
    holders = candidates.select("row").distinct()
    few = holders.count() <= BROADCAST_DOCUMENTS
    held = tokens.select("row", "words").join(F.broadcast(holders) if few else holders, "row", "left_semi")
    checked = candidates.join(held, "row").select(
        "row", "item", "shift", F.explode(F.filter("windows", same)).alias("w")
    )
    return checked.select("row", "item", (F.col("shift") + F.col("w.start")).alias("start"), F.col("w.length").alias("length"))


def proximity_hits(tokens: DataFrame, items: DataFrame, within: int = 20) -> DataFrame:
    """(row, item, pos): places of an item's rarest term around which, at most ``within`` words away, all its terms occur."""
    terms = stored(items.select(F.col("row").alias("item"), F.explode(F.array_distinct("words")).alias("term")))
    rows = terms.count()
    index = stored(postings(tokens, terms.select("term").distinct(), rows))
    counted = terms.join(index.groupBy("term").agg(F.count("*").alias("n")), "term", "left")
    per_item = Window.partitionBy("item")
    counted = counted.withColumns({
        "rarest": F.row_number().over(per_item.orderBy("n", "term")) == 1, "size": F.count("*").over(per_item),
    }).select("item", "term", "rarest", "size")
    near = Window.partitionBy("item", "row").orderBy("pos").rangeBetween(-within, within)
    placed = index.join(_side(counted, rows), "term").withColumn("near", F.size(F.collect_set("term").over(near)))
    return placed.where(F.col("rarest") & (F.col("near") == F.col("size"))).select("row", "item", "pos")


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", size: int = 10,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, spans (merged hit spans in words), n_hit, items (sorted ids as strings).

    A word is hit if it lies in any occurrence of a window of ``size`` consecutive words of a benchmark item. Null and empty
    texts have no words and no hits, on either side; repeated rows each get their own row. What is gathered per document are
    its own hits, at most its length times the items it holds. Columns named in ``carry`` come out unchanged in a
    struct ``carried``.
    """
    carried = ["carried"] if carry else []
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *([F.struct(*carry).alias("carried")] if carry else []))
    tokens = tokenised(docs, "__text", "__key", *carried)
    items = tokenised(benchmark, text, item_key)
    hits = phrase_hits(tokens, items, size).join(items.select(F.col("row").alias("item"), F.col(item_key).cast("string").alias("id")), "item")
    spans = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("found"),
        F.array_sort(F.collect_set("id")).alias("items"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    merge = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1).end >= s.start),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).start.alias("start"), F.greatest(F.element_at(done, -1).end, s.end).alias("end")))),
    ).otherwise(F.array_append(done, s))
    merged = F.aggregate("found", none, merge)
    out = tokens.select("row", F.col("__key").alias(key), *carried, F.size("words").cast("long").alias("n_words")).join(spans, "row", "left")
    out = out.withColumn("spans", F.coalesce(merged, none)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return out.select(*carried, key, "n_words", "spans", covered.alias("n_hit"), "items")
