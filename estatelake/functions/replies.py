"""Replies of an outside decision maker or translator, read back as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.fixed_values import TRANSIT_KINDS
from estatelake.functions.text import trim_all


def parse_choice(reply: Column) -> Column:
    """Struct (kind, canonical_id) of a reply holding one JSON object, possibly inside prose or a code fence."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "kind string, canonical_id string")
    kind = F.when(parsed["kind"].isin(TRANSIT_KINDS), parsed["kind"]).otherwise("unknown")
    chosen = trim_all(parsed["canonical_id"])
    usable = (chosen != "") & (F.lower(chosen) != "null") & ~kind.isin("bus", "unknown")
    return F.struct(F.coalesce(kind, F.lit("unknown")).alias("kind"), F.when(usable, chosen).alias("canonical_id"))


def numbered_replies(replies: DataFrame, reply: str, drop_unknown: bool = False) -> DataFrame:
    """One row per numbered line of a reply: all columns but the reply, plus ``item`` (1-based) and ``answer``."""
    line = r"^([0-9]+)[.)](?U)\s*(.+)$"
    keep = [c for c in replies.columns if c != reply]
    # Only lines that begin with a digit are read by the pattern, and what it found is exploded, so that no later condition reads them again.
    numbers = F.filter(F.split(reply, "\n"), lambda text: F.substring(text, 1, 1).between("0", "9"))
    found = F.transform(
        numbers,
        lambda text: F.struct(
            F.regexp_extract(text, line, 1).try_cast("int").alias("item"), trim_all(F.regexp_extract(text, line, 2)).alias("answer")
        ),
    )
    rows = replies.select(*keep, F.explode(found).alias("_found")).select(*keep, "_found.*").where(F.col("item").isNotNull())
    return rows.where(F.lower("answer") != "unknown") if drop_unknown else rows
