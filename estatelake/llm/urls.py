"""URL filter: a blocked Bloom filter over listed canonical URLs lets possible hits through to an exact hash join.

A listed entry is a host followed by a path, such as ``example.com/en/``. It covers its host and all subdomains; a path that
ends with a slash covers everything below it, any other path only itself. Of several entries that cover a URL the longest
text wins, and of equal ones the blocking one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # words of 64 bits in a block; every entry sets one bit in each


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty for null or no scheme."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks)).cast("int")


def _bits(entry: Column) -> list[Column]:
    """The bit an entry has in each word of its block."""
    spread = F.xxhash64(F.lit("bits"), entry)
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(WORDS)
    ]


def bloom_filter(entries: DataFrame, blocks: int, entry: str = "entry") -> DataFrame:
    """One row per used block with its words, built by partial ORs in every task."""
    bits = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(entry)))]
    return entries.select(_block(F.col(entry), blocks).alias("block"), *bits).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    )


def possible(probes: DataFrame, bloom: DataFrame, blocks: int, entry: str = "entry", broadcast: bool = False) -> DataFrame:
    """Probes that may be listed: never loses a listed one, lets few others through."""
    inside = [F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col(entry)))]
    condition = inside[0]
    for c in inside[1:]:
        condition = condition & c
    bloom = F.broadcast(bloom) if broadcast else bloom
    found = probes.withColumn("block", _block(F.col(entry), blocks)).join(bloom, "block").where(condition)
    return found.select(*probes.columns)


def url_verdicts(
    pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", entries_per_block: int = 16,
    broadcast_entries: int = 100_000,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages`` (columns of these names are replaced).

    ``listed`` has the columns entry and verdict (allow or block); null and repeated entries do no harm. Rows that no entry
    covers, null URLs and texts without ``://`` get a null rule and the default verdict. Only URL prefixes of the shapes
    (number of labels, number of slashes) that the list has are probed. Each distinct URL is judged once, so a URL that fills
    a third of the table costs one row. The list is counted: up to ``broadcast_entries`` the filter and the list are
    broadcast (some MB at most), beyond that both are shuffled.
    """
    listed = stored(listed.where("entry IS NOT NULL").groupBy("entry").agg(F.max("verdict").alias("entry_verdict")))
    count = listed.count()
    small = count <= broadcast_entries
    blocks = max(1, -(-count // entries_per_block))
    parts = listed.select(
        F.substring_index("entry", "/", 1).alias("h"), F.expr("substr(entry, 1 + length(substring_index(entry, '/', 1)))").alias("p")
    )
    shape = F.struct(
        F.size(F.split("h", r"\.")).alias("labels"),
        F.when(F.col("p").endswith("/"), F.size(F.split("p", "/")) - 1).otherwise(-1).alias("slashes"),
    )
    shapes = parts.agg(F.array_sort(F.collect_set(shape)).alias("shapes"))

    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    urls = pages.where("host <> ''").select("host", "path").distinct()
    entry = F.concat(
        F.expr("substring_index(host, '.', -shape.labels)"),
        F.expr("IF(shape.slashes < 0, path, IF(shape.slashes = 0, '', concat(substring_index(path, '/', shape.slashes), '/')))"),
    )
    fits = F.expr(
        "size(split(host, '\\\\.')) >= shape.labels AND (shape.slashes < 0 OR size(split(path, '/')) > shape.slashes)"
    )
    probes = (
        urls.select("host", "path", F.explode(shapes.scalar()).alias("shape"))
        .where(fits).select("host", "path", entry.alias("entry")).distinct()
    )
    hits = possible(probes, bloom_filter(listed, blocks), blocks, broadcast=small)
    exact = hits.join(F.broadcast(listed) if small else listed, "entry")
    best = F.max(F.struct(F.length("entry").alias("n"), "entry_verdict", "entry"))
    judged = exact.groupBy(F.col("host").alias("__host"), F.col("path").alias("__path")).agg(best.alias("__best"))
    same = (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path"))
    return pages.join(judged, same, "left").select(
        *pages.columns, F.col("__best.entry").alias("rule"), F.coalesce("__best.entry_verdict", F.lit(default)).alias("verdict")
    )
